"""One ride relation per city: both generations under one column list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The columns of both ride relations, in order.
_STATIONS = ("start_station_id", "start_station_name", "end_station_id", "end_station_name")
_LINEAGE = ("source_file", "location", "schema_version", "dbt_updated_at")

NYC_COLUMNS = ("ride_id", "bike_id", "start_time", "stop_time", *_STATIONS,
               "start_latitude", "start_longitude", "end_latitude", "end_longitude",
               "user_type", "duration_seconds", *_LINEAGE)
LONDON_COLUMNS = ("ride_id", "bike_id", "start_time", "stop_time", *_STATIONS,
                  "duration_seconds", *_LINEAGE)


def _lineage(*generations: DataFrame) -> list[str]:
    """The landed object's identity, where every generation has it."""
    return ["landed_id"] if all("landed_id" in g.columns for g in generations) else []


def int_nyc_rides(modern: DataFrame, legacy: DataFrame) -> DataFrame:
    """Modern rides carry no bike, so theirs is NULL."""
    modern = modern.withColumn("bike_id", F.lit(None).cast("string"))
    columns = [*NYC_COLUMNS, *_lineage(modern, legacy)]
    return modern.select(*columns).unionByName(legacy.select(*columns))


def int_london_rides(modern: DataFrame, legacy: DataFrame) -> DataFrame:
    columns = [*LONDON_COLUMNS, *_lineage(modern, legacy)]
    return modern.select(*columns).unionByName(legacy.select(*columns))
