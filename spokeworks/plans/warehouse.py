"""The tables of a deployment: one root folder, one Parquet table per relation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from spokeworks.operators.levels import LeveledTable
from spokeworks.sources import specs
from spokeworks.sources.tables import ParquetTable

REJECTS_SCHEMA = "source string, column string, raw_value string, source_file string, landed_id string"

_AUDIT = "location string, schema_version string, dbt_updated_at timestamp, source_file string, landed_id string"

#: One entry when a load of an object begins (rows NULL) and one when it is done; the latest counts.
LEDGER_SCHEMA = ("path string, source_file string, landed_id string, bytes bigint, version string,"
                 " rows bigint, rejected bigint, at timestamp")

#: A source file: two landed objects may share a name.
FILE = ("source_file", "landed_id")

#: Output columns of the staging models; the lineage column is the partition column.
STAGING_SCHEMAS = {
    "stg_nyc_legacy": (
        "ride_id string, duration_seconds decimal(18,6), start_time timestamp_ntz, stop_time timestamp_ntz,"
        " start_station_id string, start_station_name string, start_latitude double, start_longitude double,"
        " end_station_id string, end_station_name string, end_latitude double, end_longitude double,"
        " bike_id string, user_type string, birth_year int, gender int, " + _AUDIT),
    "stg_nyc_modern": (
        "ride_id string, rideable_type string, start_time timestamp_ntz, stop_time timestamp_ntz,"
        " start_station_name string, start_station_id string, end_station_name string, end_station_id string,"
        " start_latitude double, start_longitude double, end_latitude double, end_longitude double,"
        " user_type string, duration_seconds decimal(18,6), " + _AUDIT),
    "stg_london_legacy": (
        "ride_id string, bike_id string, start_time timestamp_ntz, stop_time timestamp_ntz,"
        " start_station_name string, start_station_id string, end_station_name string, end_station_id string,"
        " duration_seconds decimal(18,6), " + _AUDIT),
    "stg_london_modern": (
        "ride_id string, bike_id string, bike_model string, start_time timestamp_ntz, stop_time timestamp_ntz,"
        " start_station_name string, start_station_id string, end_station_name string, end_station_id string,"
        " duration_seconds decimal(18,6), " + _AUDIT),
}

RIDE_SCHEMAS = {
    "int_nyc_rides": (
        "ride_id string, bike_id string, start_time timestamp_ntz, stop_time timestamp_ntz,"
        " start_station_id string, start_station_name string, end_station_id string, end_station_name string,"
        " start_latitude double, start_longitude double, end_latitude double, end_longitude double,"
        " user_type string, duration_seconds decimal(18,6), " + _AUDIT),
    "int_london_rides": (
        "ride_id string, bike_id string, start_time timestamp_ntz, stop_time timestamp_ntz,"
        " start_station_id string, start_station_name string, end_station_id string, end_station_name string,"
        " duration_seconds decimal(18,6), " + _AUDIT),
}

_DAILY_HEAD = "location string, date timestamp_ntz, year bigint, day_type string, total_rides bigint, avg_duration_minutes double"
_DAILY_TAIL = "total_minutes_biked double, population bigint, rides_per_1000 double"
_HOURLY = "location string, hour_of_day bigint, ride_count bigint"
_GROWTH = ("location string, year bigint, station_count bigint, population bigint, stations_per_1000 double,"
           " prev_year_count bigint, yoy_growth decimal(18,1)")

MART_SCHEMAS = {
    "mart_nyc_daily_metrics": f"{_DAILY_HEAD}, member_rides bigint, casual_rides bigint, {_DAILY_TAIL}",
    "mart_london_daily_metrics": f"{_DAILY_HEAD}, {_DAILY_TAIL}",
    "mart_nyc_hourly_patterns": _HOURLY,
    "mart_london_hourly_patterns": _HOURLY,
    "mart_nyc_member_analysis": "location string, month timestamp_ntz, member_percentage double",
    "mart_nyc_station_growth": _GROWTH,
    "mart_london_station_growth": _GROWTH,
    "mart_daily_metrics_long": ("date timestamp_ntz, location string, year bigint, day_type string,"
                                " metric_name string, metric_value double"),
}


@dataclass(frozen=True)
class Warehouse:
    root: str

    def _table(self, layer: str, name: str, schema: str, *partition_by: str) -> ParquetTable:
        return ParquetTable(f"{self.root.rstrip('/')}/{layer}/{name}", schema, partition_by)

    def raw(self, spec: specs.SourceSpec) -> ParquetTable:
        """One partition per landed object, so loading it again replaces it."""
        return self._table("raw", spec.table, spec.raw_schema(), *FILE)

    def rejects(self) -> ParquetTable:
        return self._table("raw", "rejected_values", REJECTS_SCHEMA, *FILE)

    def ledger(self) -> ParquetTable:
        return self._table("raw", "load_ledger", f"{LEDGER_SCHEMA}, source string", "source")

    def ledger_of(self, source: str) -> ParquetTable:
        """One layout's part of the ledger: layouts are loaded side by side, and appends must not meet."""
        return ParquetTable(f"{self.ledger().path}/source={source}", LEDGER_SCHEMA)

    def staging(self, name: str) -> ParquetTable:
        return self._table("staging", name, STAGING_SCHEMAS[name], *FILE)

    def rides(self, name: str) -> ParquetTable:
        return self._table("intermediate", name, RIDE_SCHEMAS[name], *FILE)

    def _levels(self, name: str, schema: str) -> LeveledTable:
        return LeveledTable(f"{self.root.rstrip('/')}/intermediate/{name}", schema, FILE)

    def hour_totals(self, city: str, has_members: bool) -> LeveledTable:
        """What the rides of a file add to each hour: sums of it over files are those of all rides."""
        members = ", member_rides bigint, casual_rides bigint" if has_members else ""
        return self._levels(f"{city}_hour_levels", (
            "location string, date date, hour_of_day bigint, total_rides bigint, timed_rides bigint, seconds decimal(28,6)"
            + members))

    def used_stations(self, city: str) -> LeveledTable:
        return self._levels(f"{city}_station_levels", "location string, year bigint, start_station_id string")

    def mart(self, name: str) -> ParquetTable:
        return self._table("marts", name, MART_SCHEMAS[name])

    def create_raw_tables(self, spark: SparkSession) -> None:
        for spec in specs.registered():
            self.raw(spec).create(spark)
