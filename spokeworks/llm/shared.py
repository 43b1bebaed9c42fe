"""Small helpers that all operators here share: reading tables, scratch tables, Arrow functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spokeworks.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """The rows as a table in the cluster's shared scratch folder, which cuts their lineage."""
    path = scratch_path(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with this package available in the tasks."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def batch(schema: str, columns: list) -> pa.RecordBatch:
    """A batch with the declared column types; columns are arrays or lists in schema order."""
    fields = arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
         for c, f in zip(columns, fields)], schema=fields)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
          "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
          "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def fresh(taken: list[str], name: str) -> str:
    """A column name that no column of the input has."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id bigint, text string) alone: other columns, whatever their names, stay out of the way."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
