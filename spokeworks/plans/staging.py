"""Raw tables to one vocabulary of ride columns, one projection per layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spokeworks.functions.columns import current_user_type, duration_seconds, legacy_ride_key


def _audit(raw: DataFrame, location: str, generation: str) -> list[Column]:
    """Lineage; the identity of the landed object goes along where the raw rows have one."""
    return [
        F.lit(location).alias("location"),
        F.lit(generation).alias("schema_version"),
        F.current_timestamp().alias("dbt_updated_at"),
        F.col("source_file"),
        *[F.col(c) for c in raw.columns if c == "landed_id"],
    ]


def stg_nyc_legacy(raw: DataFrame) -> DataFrame:
    return raw.select(
        legacy_ride_key("bikeid", "start_station_id", "starttime", "stoptime").alias("ride_id"),
        duration_seconds("starttime", "stoptime").alias("duration_seconds"),
        F.col("starttime").alias("start_time"),
        F.col("stoptime").alias("stop_time"),
        "start_station_id", "start_station_name",
        F.col("start_station_latitude").alias("start_latitude"),
        F.col("start_station_longitude").alias("start_longitude"),
        "end_station_id", "end_station_name",
        F.col("end_station_latitude").alias("end_latitude"),
        F.col("end_station_longitude").alias("end_longitude"),
        F.col("bikeid").alias("bike_id"),
        current_user_type("usertype").alias("user_type"),
        F.col("birth_year").cast("int").alias("birth_year"),
        F.col("gender").cast("int").alias("gender"),
        *_audit(raw, "nyc", "legacy"),
    )


def stg_nyc_modern(raw: DataFrame) -> DataFrame:
    return raw.select(
        "ride_id", "rideable_type",
        F.col("started_at").alias("start_time"),
        F.col("ended_at").alias("stop_time"),
        "start_station_name", "start_station_id", "end_station_name", "end_station_id",
        F.col("start_lat").alias("start_latitude"),
        F.col("start_lng").alias("start_longitude"),
        F.col("end_lat").alias("end_latitude"),
        F.col("end_lng").alias("end_longitude"),
        F.col("member_casual").alias("user_type"),
        duration_seconds("started_at", "ended_at").alias("duration_seconds"),
        *_audit(raw, "nyc", "modern"),
    )


def stg_london_legacy(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("rental_id").alias("ride_id"),
        "bike_id",
        F.col("start_date").alias("start_time"),
        F.col("end_date").alias("stop_time"),
        "start_station_name", "start_station_id", "end_station_name", "end_station_id",
        duration_seconds("start_date", "end_date").alias("duration_seconds"),
        *_audit(raw, "london", "legacy"),
    )


def stg_london_modern(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("number").alias("ride_id"),
        F.col("bike_number").alias("bike_id"),
        "bike_model",
        F.col("start_date").alias("start_time"),
        F.col("end_date").alias("stop_time"),
        F.col("start_station").alias("start_station_name"),
        F.col("start_station_number").alias("start_station_id"),
        F.col("end_station").alias("end_station_name"),
        F.col("end_station_number").alias("end_station_id"),
        duration_seconds("start_date", "end_date").alias("duration_seconds"),
        *_audit(raw, "london", "modern"),
    )


#: Layout name -> staging model over its raw table.
MODELS = {
    "nyc_legacy": stg_nyc_legacy,
    "nyc_modern": stg_nyc_modern,
    "london_legacy": stg_london_legacy,
    "london_modern": stg_london_modern,
}
