"""CSV objects that share one header, aligned to a declared layout.

A CSV scan binds columns by position, so files are read together only when
their headers are identical, column order included.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from spokeworks.functions.parsing import blank_to_null, is_bad, parse_typed
from spokeworks.session import scratch_path
from spokeworks.sources.manifest import landed_id
from spokeworks.sources.specs import SourceSpec

#: The first field of a line beyond its header.
OVERFLOW = "_overflow"
#: The text of a line that has not as many fields as its header; a problem where a quote in it stays open.
LINE = "_line"
#: Lines that a row may be broken into.
MOST_LINES = 1000


def literal_path(path: str) -> str:
    """Spark expands globs in paths; names may contain such characters."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _decoded(name: Column) -> Column:
    """The name of an object as it was given; most names need no decoding, which is dear for every row."""
    return F.when(name.contains("%"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)


def scan_text(spark: SparkSession, header: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """All columns as text under positional names, plus lineage; nothing is inferred.

    A line break within quotes cuts a row in two; ``scan_broken`` reads such files.
    """
    names = [f"c{i}" for i in range(len(header))]
    longer = ", ".join(f"{n} string" for n in [*names, OVERFLOW])
    uri, encoded_name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    name = _decoded(encoded_name)
    beyond = F.when(F.col(LINE).isNotNull(), F.from_csv(LINE, longer, {"escape": '"'})[OVERFLOW])
    return (spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in [*names, LINE]]))
            .option("header", True).option("escape", '"')
            # With pruned columns the reader no longer sees how many fields a line has.
            .option("columnNameOfCorruptRecord", LINE).option("columnPruning", False)
            .csv([literal_path(p) for p in paths])
            .select(*names, beyond.alias(OVERFLOW), open_line(F.col(LINE)).alias(LINE),
                    name.alias("source_file"), landed_id(uri).alias("landed_id")))


def whole_rows(spark: SparkSession, paths: Sequence[str], most_lines: int = MOST_LINES) -> DataFrame:
    """(uri, name, row) of every row of files whose quoted values hold line breaks, in splits like any text.

    Where a line begins a row depends on the quotes before it in its file: the sum of every block's, one row per
    block, says whether a block begins within quotes. Each block then puts its own rows together, once, as a scratch
    table of pieces of at most ``most_lines`` lines. Only pieces that are open at an end, at most two a block but for
    stray quotes, meet those of other blocks. A quote that stays open for more than ``most_lines`` lines is a stray
    one: its lines are rows by themselves. The header is left out.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    lines = (spark.read.option("lineSep", "\n").text([literal_path(p) for p in paths])
             .select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_name").alias("name"),
                     F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
                     "value", (quotes % 2).alias("odd")))
    earlier = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = (lines.groupBy("uri", "block").agg(F.sum("odd").alias("odd"))
              .select("uri", "block", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("opened")))
    of_block = Window.partitionBy("uri", "block").orderBy("at")
    until = of_block.rowsBetween(Window.unboundedPreceding, 0)
    inside = (F.col("opened") + F.sum("odd").over(until) - F.col("odd")) % 2
    # Rows of a block are numbered from 1; 0 goes on from the block before.
    numbered = (lines.join(opened, ["uri", "block"]).withColumn("begins", (inside == 0).cast("bigint"))
                .withColumns({"number": F.sum("begins").over(until), "line": F.row_number().over(of_block)})
                .withColumn("first", F.coalesce(F.max(F.when(F.col("begins") == 1, F.col("line"))).over(until), F.lit(1)))
                .withColumn("chunk", F.floor((F.col("line") - F.col("first")) / most_lines)))
    # Parted by block already, so the pieces need no shuffle of their own.
    pieces = (numbered.groupBy("uri", "name", "block", "number", "chunk")
              .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"), (F.sum("odd") % 2).alias("odd"))
              .select("uri", "name", "block", "number", "chunk", F.col("parts.value").alias("lines"),
                      (F.expr("number > 0 AND chunk = 0") & (F.col("odd") == 0)).alias("closed")))
    path = scratch_path(spark, "broken-rows")
    pieces.write.parquet(path)
    stored = spark.read.parquet(path)
    whole = stored.filter("closed AND NOT (block = 0 AND number = 1)").select("uri", "name", F.array_join("lines", "\n").alias("row"))
    loose, place = stored.filter("NOT closed"), ["uri", "block", "number", "chunk"]
    in_file = Window.partitionBy("uri").orderBy("block", "number", "chunk").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.expr("number > 0 AND chunk = 0").cast("bigint")
    ids = loose.select(*place, F.size("lines").alias("held"), F.sum(starts).over(in_file).alias("id"))
    rows = ids.groupBy("uri", "id").agg(F.sum("held").alias("of_row"), F.max(F.expr("block = 0 AND number = 1")).alias("header"))
    sized = loose.join(ids.join(rows, ["uri", "id"]).filter("NOT header").select(*place, "id", "of_row"), place)
    joined = (sized.filter(F.col("of_row") <= most_lines).groupBy("uri", "name", "id")
              .agg(F.array_sort(F.collect_list(F.struct("block", "number", "chunk", "lines"))).alias("parts"))
              .select("uri", "name", F.array_join(F.flatten("parts.lines"), "\n").alias("row")))
    stray = sized.filter(F.col("of_row") > most_lines).select("uri", "name", F.explode("lines").alias("row"))
    return whole.unionByName(joined).unionByName(stray).withColumn("row", F.regexp_replace("row", "\r$", ""))


def scan_broken(spark: SparkSession, header: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """What ``scan_text`` gives, of files whose rows break within quotes; no file is one task's work."""
    names = [f"c{i}" for i in range(len(header))]
    fields = ", ".join(f"{n} string" for n in [*names, LINE])
    longer = ", ".join(f"{n} string" for n in [*names, OVERFLOW])
    rows = whole_rows(spark, paths).filter("row <> ''")
    parsed = F.from_csv("row", fields, {"escape": '"', "columnNameOfCorruptRecord": LINE})
    # Unnested as a row of its own: a filter on its fields would else be moved below and parse the row for each of them.
    read = rows.select("uri", "name", "row", F.inline(F.array(parsed)))
    beyond = F.when(F.col(LINE).isNotNull(), F.from_csv("row", longer, {"escape": '"'})[OVERFLOW])
    name = _decoded(F.col("name"))
    return read.select(*names, beyond.alias(OVERFLOW),
                       open_line(F.when(F.col(LINE).isNotNull(), F.col("row"))).alias(LINE),
                       name.alias("source_file"), landed_id(F.col("uri")).alias("landed_id"))


def open_line(line: Column) -> Column:
    """The line if it has an odd number of quotes, as each part of a row cut within quotes has."""
    return F.when((F.length(line) - F.length(F.replace(line, F.lit('"')))) % 2 == 1, line)


def column_texts(spec: SourceSpec, header: Sequence[str]) -> list[Column]:
    """The text of each declared column; NULL where an optional one is absent."""
    position: dict[str, int] = {}
    for i, name in enumerate(header):
        position.setdefault(name, i)
    return [
        blank_to_null(F.col(f"c{position[f.header]}")) if f.header in position
        else F.lit(None).cast("string")
        for f in spec.fields
    ]


def align(text_rows: DataFrame, spec: SourceSpec, header: Sequence[str]) -> DataFrame:
    """Renamed, typed and ordered columns, lineage, and ``problems`` of each row.

    ``problems`` is an array of (column, raw value); an empty array is a good row.
    Values are parsed in a projection of their own, so that each is parsed once.
    """
    texts = column_texts(spec, header)
    typed = [f for f in spec.fields if f.kind != "string"]
    parsed = text_rows.select(
        *[parse_typed(t, f.kind, f.layouts).alias(f.name) for t, f in zip(texts, spec.fields)],
        *[t.alias(f"_raw_{f.name}") for t, f in zip(texts, spec.fields) if f in typed],
        OVERFLOW, LINE, "source_file", "landed_id")
    found = [
        F.when(is_bad(F.col(f"_raw_{f.name}"), F.col(f.name)),
               F.struct(F.lit(f.name).alias("column"), F.col(f"_raw_{f.name}").alias("raw_value")))
        for f in typed
    ]
    found += [F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("column"), F.col(n).alias("raw_value")))
              for n in (OVERFLOW, LINE)]
    return parsed.select(
        *[f.name for f in spec.fields],
        F.current_timestamp().alias("ingested_at"), "source_file", "landed_id",
        F.array_compact(F.array(*found)).alias("problems"))


def scan_aligned(spark: SparkSession, spec: SourceSpec,
                 scans: Mapping[tuple[str, ...], Sequence[str]], broken: bool = False) -> DataFrame:
    """Rows of files of one layout, given as {header: paths}; ``broken`` where rows have line breaks in them."""
    scan = scan_broken if broken else scan_text
    parts = [align(scan(spark, header, paths), spec, header) for header, paths in scans.items()]
    return reduce(DataFrame.unionByName, parts)


def good_rows(aligned: DataFrame) -> DataFrame:
    return aligned.filter(F.size("problems") == 0).drop("problems")


def cut_files(rejects: DataFrame) -> DataFrame:
    """(source_file, landed_id) of files with a row that a quoted line break has cut."""
    return rejects.filter(F.col("column") == LINE).select("source_file", "landed_id").distinct()


def rejected_values(aligned: DataFrame, spec: SourceSpec) -> DataFrame:
    """One row per value that could not be read."""
    return (aligned.filter(F.size("problems") > 0)
            .select("source_file", "landed_id", F.explode("problems").alias("p"))
            .select(F.lit(spec.name).alias("source"), F.col("p.column").alias("column"),
                    F.col("p.raw_value").alias("raw_value"), "source_file", "landed_id"))
