"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

Every source gets a repetition rate, target bytes over present bytes. A document is repeated as often as a
Poisson variable with that mean, found by inverting its distribution at a number in (0, 1) that a hash of
seed and id gives. Copies are exploded where the document is read and dealt once, by a hash of seed, id and
copy: a global shuffle. The count of a document depends on its id and its source's rate only.

Rates above ``PART`` are split into equal parts whose counts are added, so that no term underflows.
Sources need not be few: their rates are broadcast only after a count shows at most ``FEW`` of them, and
joined by a shuffle that adaptive execution splits otherwise.

Defined results: a null source is a source of its own; null and empty texts have no bytes, and a source
without bytes has rate zero; documents with equal ids get equal counts, a null id is an id like others;
columns named like an output column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Largest mean whose distribution is inverted at once, and terms that hold all of its mass.
PART, TERMS = 32.0, 160
#: Sources whose rates may be broadcast (a rate takes some 1.5 KB with its table).
FEW = 2000
OUT = ("copy_no", "shuffle_key")


def uniform(*parts: str) -> str:
    """SQL for a number in (0, 1) from 52 bits of a hash of the parts."""
    joined = ", '|', ".join(f"coalesce(cast({p} AS string), '')" for p in parts)
    return f"(cast(conv(substr(md5(concat({joined})), 1, 13), 16, 10) AS double) + 0.5) / 4503599627370496D"


def source_rates(docs: DataFrame, alpha: float, epochs: float) -> DataFrame:
    """(mix_source, mean): repetition rates when the target weight of a source is its bytes to ``alpha``.

    Weights are whole thousandths, so that their sum doesn't depend on its order. ``epochs`` is the size of
    the mixture in sizes of the input.
    """
    sizes = (docs.groupBy(F.col("source").cast("string").alias("mix_source"))
             .agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).filter("bytes > 0")
             .withColumn("weight", F.floor(F.pow(F.col("bytes").cast("double"), F.lit(alpha)) * 1000)))
    total = sizes.agg(F.sum("bytes").alias("bytes"), F.sum("weight").alias("weight")).first()
    mean = (F.lit(float(epochs)) * (total["bytes"] or 0) * F.col("weight").cast("double")
            / (F.lit(float(total["weight"] or 1)) * F.col("bytes").cast("double")))
    return sizes.select("mix_source", mean.alias("mean"))


def given_rates(docs: DataFrame, weights: dict[str, float], epochs: float) -> DataFrame:
    """(mix_source, mean) for target weights that the caller names; other sources are left out."""
    rows = docs.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "mix_source string, share double")
    sizes = (docs.groupBy(F.col("source").cast("string").alias("mix_source"))
             .agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    whole = sum(weights.values()) or 1.0
    return (sizes.filter("bytes > 0").join(F.broadcast(rows), "mix_source")
            .select("mix_source", (F.lit(epochs * total / whole) * F.col("share") / F.col("bytes")).alias("mean")))


def _with_tables(rates: DataFrame) -> DataFrame:
    """Adds the number of parts and the cumulative distribution of one part."""
    return (rates.withColumn("parts", F.ceil(F.col("mean") / PART).cast("int"))
            .withColumn("part_mean", F.col("mean") / F.greatest("parts", F.lit(1)))
            .withColumn("cumulative", F.expr(
                f"aggregate(sequence(1, {TERMS}), named_struct('p', exp(-part_mean), 'sums', array(exp(-part_mean))),"
                " (s, j) -> named_struct('p', s.p * part_mean / j, 'sums',"
                " concat(s.sums, array(element_at(s.sums, -1) + s.p * part_mean / j)))).sums")))


def counts(seed: int) -> Column:
    """How often a row with parts and cumulative is repeated: terms below the number drawn, over all parts."""
    drawn = uniform(f"'{seed}'", "doc_id", "i")
    return F.expr("CASE WHEN parts IS NULL OR parts = 0 THEN 0 ELSE aggregate(sequence(1, parts), 0, "
                  f"(n, i) -> n + size(filter(cumulative, c -> c < {drawn}))) END")


def mixed(docs: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """The copies of all documents in global random order, with ``copy_no`` (from 0) and ``shuffle_key``."""
    tables = _with_tables(rates).select("mix_source", "parts", "cumulative")
    if rates.limit(FEW + 1).count() <= FEW:
        tables = F.broadcast(tables)
    rows = docs.drop(*OUT)
    names = [F.col(f"`{c}`") for c in rows.columns]
    packed = rows.select(F.struct(*names).alias("row"), F.col("source").cast("string").alias("own_source"),
                         F.col("doc_id"))
    copies = (packed.join(tables, F.col("own_source").eqNullSafe(F.col("mix_source")))
              .withColumn("n", counts(seed)).filter("n > 0")
              .select("row", "doc_id", F.explode(F.expr("sequence(0, n - 1)")).alias("copy_no")))
    key = F.expr(f"cast(conv(substr(md5(concat('{seed}|', coalesce(cast(doc_id AS string), ''), '|', copy_no)), 1, 15),"
                 " 16, 10) AS bigint)")
    return (copies.select("row", "copy_no", key.alias("shuffle_key")).repartition("shuffle_key")
            .sortWithinPartitions("shuffle_key").select("row.*", "copy_no", "shuffle_key"))


def oracle(alpha: float, epochs: float, seed: int) -> str:
    """The same mixture in DuckDB, with the distribution written out term by term."""
    return f"""
    WITH sizes AS (
      SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY source HAVING sum(octet_length(encode(text))) > 0),
    weighted AS (SELECT source, bytes, floor(pow(bytes::DOUBLE, {alpha}) * 1000)::BIGINT AS weight FROM sizes),
    rates AS (
      SELECT source, {epochs}::DOUBLE * (SELECT sum(bytes) FROM weighted)::DOUBLE * weight::DOUBLE
        / ((SELECT sum(weight) FROM weighted)::DOUBLE * bytes::DOUBLE) AS mean FROM weighted),
    split AS (SELECT source, ceil(mean / {PART})::BIGINT AS parts, mean / greatest(ceil(mean / {PART}), 1) AS part_mean FROM rates),
    terms AS (
      SELECT source, parts, j, sum(exp(j * ln(part_mean) - part_mean - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS mass
      FROM split, range(0, {TERMS + 1}) r(j) WHERE part_mean > 0),
    tables AS (SELECT source, parts, list(mass ORDER BY j) AS masses FROM terms GROUP BY source, parts),
    drawn AS (
      SELECT d.*, i, (('0x' || substr(md5('{seed}|' || coalesce(d.doc_id::VARCHAR, '') || '|' || i), 1, 13))::BIGINT::DOUBLE + 0.5)
        / 4503599627370496 AS u, masses
      FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source, unnest(range(1, parts + 1)) x(i)),
    counted AS (
      SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(masses, lambda m: m < u)))::BIGINT AS n
      FROM drawn GROUP BY ALL)
    SELECT doc_id, text, lang, source, n_chars, c::INTEGER AS copy_no,
      ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || c), 1, 15))::BIGINT AS shuffle_key
    FROM counted, unnest(range(0, n)) y(c)"""
