"""Residents per city and year, the seed the per-1,000 rates divide by."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "location string, year bigint, population bigint"

#: Fixed values: (location, year, population).
POPULATION = (
    ("nyc", 2019, 8336817),
    ("nyc", 2020, 8740292),
    ("nyc", 2021, 8462216),
    ("nyc", 2022, 8335798),
    ("nyc", 2023, 8258035),
    ("nyc", 2024, 8480000),
    ("london", 2019, 8961000),
    ("london", 2020, 9002000),
    ("london", 2021, 8800000),
    ("london", 2022, 8866180),
    ("london", 2023, 8945300),
    ("london", 2024, 9030000),
)


def seed_population(spark: SparkSession) -> DataFrame:
    """The seed as a local relation: its size is known, so Spark may broadcast it by itself."""
    columns = zip(("location", "year", "population"), zip(*POPULATION))
    return spark.createDataFrame(pa.table({name: list(values) for name, values in columns}), SCHEMA)


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """A population CSV with its header; columns are declared, never inferred."""
    return spark.read.schema(SCHEMA).option("header", True).csv(path)


def check_unique(population: DataFrame) -> DataFrame:
    """Refuse a seed with two rows for a city and year: it would multiply the rates."""
    repeated = population.groupBy("location", "year").count().filter("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"population lists a city and year more than once: {repeated}")
    return population
