"""Typed-value checks over landed text: how many values would not read as declared."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spokeworks.functions.parsing import is_bad, parse_timestamp, parse_typed
from spokeworks.sources.csv_scan import column_texts
from spokeworks.sources.specs import SourceSpec

#: Size of a quantile sketch; a rank is off by some 1.7 percent of the rides at most, 99 times in 100.
SKETCH = 200


def is_valid(text: Column, *kinds: str) -> Column:
    """Does the text satisfy any of the kinds? Text passes ``string`` whatever it says."""
    passed = F.lit(False)
    for kind in kinds:
        if kind == "string":
            ok = text.isNotNull()
        elif kind in ("bigint", "double"):
            ok = text.try_cast("double").isNotNull()
        elif kind == "timestamp_ntz":
            ok = parse_timestamp(text, ("iso", "month_first")).isNotNull()
        else:
            raise ValueError(f"no check for kind {kind!r}")
        passed = passed | F.coalesce(ok, F.lit(False))
    return passed


def invalid_counts(rows: DataFrame, kinds: Mapping[str, tuple[str, ...]], by: str = "source_file") -> DataFrame:
    """Per file and column: values present, and those that fail every declared kind.

    One pass with conditional counts, then one output row per column.
    """
    measured = rows.groupBy(by).agg(*[
        F.struct(
            F.count(c).alias("present"),
            F.count_if(F.col(c).isNotNull() & ~is_valid(F.col(c), *k)).alias("invalid"),
        ).alias(c) for c, k in kinds.items()
    ])
    return (measured.select(by, F.explode(F.array(*[
                F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in kinds])).alias("m"))
            .select(by, "m.column_name", "m.n.present", "m.n.invalid"))


def layout_counts(rows: DataFrame, spec: SourceSpec) -> DataFrame:
    """Per file and declared column of a layout: rows, values present, and those that do not read as declared.

    ``rows`` are texts under the layout's headers; what pandas takes for missing is not present. One pass.
    """
    texts = rows.select("source_file", *[F.col(f"`{f.header}`").alias(f"c{i}") for i, f in enumerate(spec.fields)])
    header = [f.header for f in spec.fields]
    parsed = texts.select("source_file", *[t.alias(f.name) for t, f in zip(column_texts(spec, header), spec.fields)])
    measured = parsed.groupBy("source_file").agg(F.count("*").alias("rows"), *[
        F.struct(F.count(f.name).alias("present"),
                 F.count_if(is_bad(F.col(f.name), parse_typed(F.col(f.name), f.kind, f.layouts))).alias("invalid")).alias(f.name)
        for f in spec.fields])
    each = F.array(*[F.struct(F.lit(f.header).alias("column_name"), F.col(f.name).alias("n")) for f in spec.fields])
    return (measured.select("source_file", "rows", F.explode(each).alias("m"))
            .select("source_file", F.lit(spec.name).alias("source"), "m.column_name", "rows", "m.n.present", "m.n.invalid"))


def duration_summaries(rides: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group, such as a file: rides, exact counts of missing, zero and negative durations, and a quantile sketch.

    Summaries of groups merge, see ``merged_durations``, so rides are read once.
    """
    seconds = F.col("duration_seconds")
    return rides.groupBy(*by).agg(
        F.count("*").alias("rides"), F.count_if(seconds.isNull()).alias("missing"), F.count_if(seconds == 0).alias("zero"),
        F.count_if(seconds < 0).alias("negative"), F.kll_sketch_agg_double(seconds.cast("double"), F.lit(SKETCH)).alias("sketch"))


def merged_durations(summaries: DataFrame, by: Sequence[str], fractions: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Summaries of a coarser grain, with the quantiles of their durations as columns q05, q50.."""
    counts = [F.sum(n).alias(n) for n in ("rides", "missing", "zero", "negative")]
    merged = summaries.groupBy(*by).agg(*counts, F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
    known = F.kll_sketch_get_n_double("sketch") > 0
    return merged.select(*by, "rides", "missing", "zero", "negative", *[
        F.when(known, F.kll_sketch_get_quantile_double("sketch", F.lit(f))).alias(f"q{round(100 * f):02d}") for f in fractions])
