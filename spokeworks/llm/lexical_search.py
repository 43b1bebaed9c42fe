"""Ranked lexical search by pipelined term partitioning.

Terms are owned by stages, from the rarest to the most common by the share of documents that hold them, and within a
stage by shards of documents. Items travel in bundles: a bundle carries, for each of its items and one shard, the
sparse accumulators of the documents met so far. Stage by stage it is cogrouped with the postings that the stage owns
in that shard, and whole-number contributions are added.

Between stages an accumulator goes where it can't reach the shard's ``k`` best any more: it lies below the ``k``-th
of them by more than all later terms could add. That bound is safe, ties included, so results are those of a scan of
all postings. The last stage leaves ``k`` documents per item and shard, and a final ranking takes the best.

A task holds one block of items (``ITEMS``) and the postings of one shard (``DOCUMENTS``); neither grows with the
tables. Which terms a stage owns is told to the tasks that cut documents into terms by bitmaps of fixed size; one that
lets a term of another stage through does no harm, as no item asks for it there. A term's identity is a 64-bit hash.

Defined results: null and empty texts have no terms; items without terms, or whose terms no document holds, have no
rows; repeated documents and items are answered one by one, and equal scores (ties) go by id, a null id last; very
long texts are read whole; columns other than id and text are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from spokeworks.llm import shared, textbytes
from spokeworks.llm.bitmaps import Bitmap

#: Items of a block and documents of a shard.
ITEMS, DOCUMENTS = 256, 4096
#: A term belongs to the first stage whose share of the documents (one in so many) it stays below; others to the last.
SHARES = (1024, 64, 8)
#: The most that one occurrence in an item adds per unit of a term's weight.
MOST = 1_000_000

# Letters, digits and all characters beyond ASCII make terms; A-Z are lower-cased.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

TERMS = "row bigint, id bigint, n bigint, terms array<bigint>, counts array<bigint>"


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    """Rows of values that begin at ``starts``, which has one more at the end."""
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _terms(wanted):
    """The Arrow function from (row, id, text) to the distinct terms of each text and how often they occur.

    Only terms that the bitmap may hold are listed, where one is given; ``n`` counts all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textbytes.slices(batches, "text"):
            data, offsets = textbytes.buffer_of(part.column("text"))
            inside = _INSIDE[data]
            before, after = np.zeros_like(inside), np.zeros_like(inside)
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = offsets[(offsets > 0) & (offsets < len(data))]
            before[edges] = False
            after[edges - 1] = False
            starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            hashes = textbytes.span_hashes(_LOWER[data], starts, ends)
            text = np.searchsorted(offsets, starts, "right") - 1
            n = np.bincount(text, minlength=part.num_rows)
            if wanted is not None:
                kept = np.flatnonzero(wanted.value.holds(hashes))
                text, hashes = text[kept], hashes[kept]
            order = np.lexsort((hashes, text))
            text, hashes = text[order], hashes[order]
            fresh = np.ones(len(text), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
            heads = np.flatnonzero(fresh)
            counts = np.diff(np.append(heads, len(text)))
            begins = np.searchsorted(text[heads], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("id"), pa.array(n), _lists(begins, hashes[heads].view(np.int64)),
                 _lists(begins, counts)], schema=shared.arrow_schema(TERMS))

    return run


def terms_of(rows: DataFrame, key: str, wanted=None) -> DataFrame:
    """(row, id, n, terms, counts) of every row; the last bit of ``row`` says that the id is null."""
    numbered = rows.select((F.monotonically_increasing_id() * 2 + F.isnull(F.col(f"`{key}`")).cast("bigint")).alias("row"),
                           F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(2 ** 63 - 1)).alias("id"),
                           F.col("text").cast("string").alias("text"))
    return shared.arrow_map(numbered, _terms(wanted), TERMS)


def stage_sql() -> str:
    """SQL for the stage that owns a term with document frequency ``df`` among ``total`` documents."""
    cases = " ".join(f"WHEN df * {s} < total THEN {i}" for i, s in enumerate(SHARES))
    return f"CASE {cases} ELSE {len(SHARES)} END"


POSTINGS = "row bigint, id bigint, terms array<bigint>, parts array<bigint>"


def _owned(terms, documents: int, length: int):
    """The Arrow function from documents to their postings under one stage's terms.

    A part is what a posting adds per unit of the term's weight; ``documents`` and ``length`` are those of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            hashes, counts = lists.flatten().to_numpy(), part.column("counts").flatten().to_numpy()
            mean = 25 + 75 * part.column("n").to_numpy() * documents // length
            kept = np.flatnonzero(terms.value.holds(hashes.view(np.uint64)))
            doc = np.repeat(np.arange(len(sizes)), sizes)[kept]
            parts = 1_000_000_000 * counts[kept] // (1000 * counts[kept] + 8 * mean[doc])
            some, heads = np.unique(doc, return_index=True)
            begins = np.append(heads, len(doc))
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(pa.array(some)) for c in ("row", "id")]
                + [_lists(begins, hashes[kept]), _lists(begins, parts)], schema=shared.arrow_schema(POSTINGS))

    return run


BUNDLE = ("block bigint, shard bigint, item bigint, item_id bigint, terms array<bigint>, gains array<bigint>,"
          " stages array<bigint>, rows array<bigint>, ids array<bigint>, scores array<bigint>")
_FIXED = ("block", "shard", "item", "item_id", "terms", "gains", "stages")


def _flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    lists = table.column(column).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    offsets = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return offsets, lists.flatten().to_numpy(zero_copy_only=False)


def _visit(stage: int, last: bool, k: int):
    """What a bundle does at a stage: add the contributions of its terms, and drop what can't be among the best."""

    def run(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        (at, terms), (_, gains), (_, stages) = (_flat(bundle, c) for c in ("terms", "gains", "stages"))
        (met, old), (_, old_ids), (_, sums) = (_flat(bundle, c) for c in ("rows", "ids", "scores"))
        begins, owned = _flat(postings, "terms")
        _, parts = _flat(postings, "parts")
        order = np.argsort(owned, kind="stable")
        owned, parts = owned[order], parts[order]
        both = np.concatenate([postings.column("row").to_numpy(), old])
        rows, first, number = np.unique(both, return_index=True, return_inverse=True)
        ids = np.concatenate([postings.column("id").to_numpy(), old_ids])[first]
        holder = number[:postings.num_rows][np.repeat(np.arange(postings.num_rows), np.diff(begins))[order]]
        carried = number[postings.num_rows:]
        kept_rows, kept_scores, sizes = [], [], [0]
        for i in range(bundle.num_rows):
            score = np.zeros(len(rows), np.int64)
            score[carried[met[i]:met[i + 1]]] = sums[met[i]:met[i + 1]]
            mine = slice(at[i], at[i + 1])
            now = np.flatnonzero(stages[mine] == stage) + at[i]
            for low, high, gain in zip(np.searchsorted(owned, terms[now]), np.searchsorted(owned, terms[now], "right"), gains[now]):
                score[holder[low:high]] += gain * parts[low:high]
            some = np.flatnonzero(score)
            if len(some) > k:
                least = np.partition(score[some], len(some) - k)[len(some) - k]
                later = MOST * int(gains[mine][stages[mine] > stage].sum())
                some = some[score[some] + later >= least]
                if last and len(some) > k:
                    some = some[np.lexsort((ids[some], -score[some]))[:k]]
            kept_rows.append(some)
            kept_scores.append(score[some])
            sizes.append(len(some))
        ends = np.cumsum(sizes)
        some = np.concatenate(kept_rows) if kept_rows else np.zeros(0, np.int64)
        scores = np.concatenate(kept_scores) if kept_scores else np.zeros(0, np.int64)
        columns = [bundle.column(c).combine_chunks() for c in _FIXED]
        return pa.Table.from_arrays([*columns, _lists(ends, rows[some]), _lists(ends, ids[some]), _lists(ends, scores)],
                                    schema=shared.arrow_schema(BUNDLE))

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above zero."""
    spark = docs.sparkSession
    asked = shared.written(terms_of(items, "item_id"), "search-items")
    each = asked.select("row", "id", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select(
        "row", "id", F.col("e.terms").alias("term"), F.col("e.counts").alias("times"))
    wanted = spark.sparkContext.broadcast(Bitmap(each.select("term").distinct(), "term"))
    index = shared.written(terms_of(docs, "doc_id", wanted), "search-index", "zstd")
    corpus = index.agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = corpus["documents"], corpus["length"] or 1
    weights = (index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
               .withColumn("total", F.lit(documents))
               .select("term", F.expr("cast(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS bigint)").alias("weight"),
                       F.expr(f"cast({stage_sql()} AS bigint)").alias("stage")))
    sought = shared.written(each.join(weights, "term"), "search-terms")
    shards, blocks = -(-corpus["rows"] // DOCUMENTS) or 1, -(-asked.count() // ITEMS) or 1
    nothing = F.array().cast("array<bigint>")
    per_item = F.array_sort(F.collect_list(F.struct("term", (F.col("times") * F.col("weight")).alias("gain"), "stage")))
    bundles = (sought.groupBy(F.col("row").alias("item"), F.col("id").alias("item_id")).agg(per_item.alias("t"))
               .select(F.expr(f"pmod(xxhash64(item), {blocks})").alias("block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"),
                       "item", "item_id", F.col("t.term").alias("terms"), F.col("t.gain").alias("gains"), F.col("t.stage").alias("stages"),
                       nothing.alias("rows"), nothing.alias("ids"), nothing.alias("scores")))
    for stage in range(len(SHARES) + 1):
        terms = spark.sparkContext.broadcast(Bitmap(sought.filter(F.col("stage") == stage).select("term").distinct(), "term"))
        postings = shared.arrow_map(index, _owned(terms, documents, length), POSTINGS).select(
            F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.expr(f"pmod(xxhash64(row), {shards})").alias("shard"), "*")
        bundles = (bundles.groupBy("block", "shard").cogroup(postings.groupBy("block", "shard"))
                   .applyInArrow(_visit(stage, stage == len(SHARES), k), BUNDLE))
    found = bundles.select("item", "item_id", F.explode(F.arrays_zip("rows", "ids", "scores")).alias("e")).select(
        "item", "item_id", F.col("e.rows").alias("row"), F.col("e.ids").alias("id"), F.col("e.scores").alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), "id", "row")
    named = lambda key, value: F.when(F.col(key).bitwiseAND(1) == 0, F.col(value))
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select(named("item", "item_id").alias("item_id"), "rank", named("row", "id").alias("doc_id"), "score"))


def oracle(k: int = 10) -> str:
    """The same ranking in DuckDB, over all postings."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = "regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".format(
        u=upper, l=upper.lower())
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents),
    i AS (SELECT row_number() OVER () AS q, item_id, {terms} AS t FROM benchmark),
    corpus AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS total, sum(len(t))::BIGINT AS length FROM d),
    postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
    weights AS (
      SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, corpus GROUP BY term, total),
    asked AS (SELECT q, item_id, unnest(t) AS term FROM i),
    scores AS (
      SELECT q, item_id, doc_id, r, sum(w * (1000000000 * tf // (1000 * tf + 8 * (25 + 75 * len(t) * total // length))))::BIGINT AS score
      FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN d USING (r), corpus GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM scores WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
