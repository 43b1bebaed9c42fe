"""Which layout does each landed file have? Decided by its header line alone."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spokeworks.session import ship_package
from spokeworks.sources import specs
from spokeworks.sources.objects import open_object


def first_fields(path: str) -> list[str]:
    """Column names on the first line; an empty object has none."""
    with open_object(path) as raw, io.TextIOWrapper(raw, "utf-8-sig", errors="replace") as text:
        return next(csv.reader([text.readline().rstrip("\r\n")]), [])


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["header"] = [first_fields(p) for p in batch["path"]]
        yield batch


def with_headers(manifest: DataFrame) -> DataFrame:
    """Adds ``header array<string>``; each task opens a slice of the files and reads one line each.

    The listing arrives packed by byte size, so a few tasks would otherwise open
    every file: spread by path first (a shuffle of paths, not of data).
    """
    ship_package(manifest.sparkSession)
    schema = T.StructType([*manifest.schema.fields, T.StructField("header", T.ArrayType(T.StringType()))])
    slices = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.repartition(slices, "path").mapInPandas(_read_headers, schema)


def missing_columns(spec: specs.SourceSpec, header: Column | str = "header") -> Column:
    have = F.col(header) if isinstance(header, str) else header
    return F.array_except(F.array(*[F.lit(h) for h in spec.required_headers]), have)


def fits(spec: specs.SourceSpec) -> Column:
    """Under the layout's prefix and every required column is there; extras are fine."""
    return (F.col("prefix") == spec.prefix) & (F.size(missing_columns(spec)) == 0)


def assign_source(manifest: DataFrame) -> DataFrame:
    """Adds ``source`` (first registered layout that fits, else NULL) and ``candidates``."""
    named = [F.when(fits(s), s.name) for s in specs.registered()]
    return manifest.withColumns({
        "source": F.coalesce(*named),
        "candidates": F.array_compact(F.array(*named)),
    })


def missing_report(manifest: DataFrame) -> DataFrame:
    """For files no layout fits: every candidate layout with the columns it misses."""
    per_spec = [
        F.when(F.col("prefix") == s.prefix, F.struct(
            F.lit(s.name).alias("candidate"), missing_columns(s).alias("missing")))
        for s in specs.registered()
    ]
    return (assign_source(manifest).filter("source is null")
            .select("path", "source_file", "prefix",
                    F.explode(F.array_compact(F.array(*per_spec))).alias("c"))
            .select("path", "source_file", "prefix", "c.candidate",
                    F.explode("c.missing").alias("missing_column")))
