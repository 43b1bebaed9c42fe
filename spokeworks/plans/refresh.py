"""Bring the warehouse up to date: raw -> staging -> rides -> marts -> long mart."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, types as T

from spokeworks.operators.increments import append_unseen, ledger_of, replace_by_key, rows_of_files
from spokeworks.operators.levels import LeveledTable
from spokeworks.plans import marts, rides, staging
from spokeworks.plans.load import loaded_versions
from spokeworks.plans.warehouse import FILE, MART_SCHEMAS, RIDE_SCHEMAS, Warehouse
from spokeworks.sources import specs
from spokeworks.sources.population import check_unique

RIDE_KEY = ["ride_id"]


def staged(spark: SparkSession, warehouse: Warehouse, source: str) -> DataFrame:
    """A staging model as a view over its raw table."""
    return staging.MODELS[source](warehouse.raw(specs.get(source)).read(spark))


def refresh_staging(spark: SparkSession, warehouse: Warehouse, on_duplicates: str = "error") -> None:
    """Store the staging models too: modern NYC rebuilt, the others replaced by key.

    Optional. As views they cost one projection when the rides are loaded, as
    tables a second copy of every ride.
    """
    for source in staging.MODELS:
        table = warehouse.staging(f"stg_{source}")
        if source == "nyc_modern":
            table.rebuild(staged(spark, warehouse, source))
        else:
            replace_by_key(spark, staged(spark, warehouse, source), table, RIDE_KEY, on_duplicates,
                           loaded_versions(spark, warehouse, [source]))


def refresh_rides(spark: SparkSession, warehouse: Warehouse, stored_staging: bool = False,
                  on_duplicates: str = "error", only: DataFrame | None = None) -> None:
    """Each version of a source file once: NYC rides are appended, London rides replace by key.

    A file that was loaded again with another content gives its rides anew, and those it had before go.
    ``only`` are the files (source_file, landed_id) to look at, where the caller knows which were loaded.
    """
    def versions(*sources: str) -> DataFrame | None:
        loaded = loaded_versions(spark, warehouse, sources)
        return loaded if loaded is None or only is None else loaded.join(only.select(*FILE), list(FILE), "left_semi")

    def model(source: str) -> DataFrame:
        if stored_staging:
            return warehouse.staging(f"stg_{source}").read(spark)
        return staged(spark, warehouse, source)

    append_unseen(spark, rides.int_nyc_rides(model("nyc_modern"), model("nyc_legacy")),
                  warehouse.rides("int_nyc_rides"), versions=versions("nyc_modern", "nyc_legacy"))
    replace_by_key(spark, rides.int_london_rides(model("london_modern"), model("london_legacy")),
                   warehouse.rides("int_london_rides"), RIDE_KEY, on_duplicates,
                   versions("london_modern", "london_legacy"))


def refresh_marts(spark: SparkSession, warehouse: Warehouse, population: DataFrame) -> None:
    """Rebuild every mart from tables kept per file of the rides; only new or rewritten files are read.

    Rides come down to city x day x hour, which the daily, hourly and membership marts are
    read from, and to the stations in use; both add up over files and lie in few segments.
    """
    check_unique(population)
    changed = {city: ledger_of(spark, warehouse.rides(f"int_{city}_rides")).marks(spark) for city in ("nyc", "london")}

    def in_step(city: str, table: LeveledTable, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The table after the files of the city's rides that changed since were made again."""
        ridden = warehouse.rides(f"int_{city}_rides")
        schema = T.StructType.fromDDL(", ".join([table.schema, *(f"{c} string" for c in FILE)]))
        table.keep_in_step(spark, changed[city], lambda stale: made(
            rows_of_files(ridden.read(spark), stale, FILE)).to(schema))
        return table.read(spark)

    def city_marts(city: str, has_members: bool) -> None:
        hours = in_step(city, warehouse.hour_totals(city, has_members), lambda new: marts.hour_totals(new, has_members, FILE))
        warehouse.mart(f"mart_{city}_daily_metrics").rebuild(marts.daily_from_hours(hours, population))
        warehouse.mart(f"mart_{city}_hourly_patterns").rebuild(marts.hourly_from_hours(hours))
        if has_members:
            warehouse.mart(f"mart_{city}_member_analysis").rebuild(marts.members_from_hours(hours))

    def city_growth(city: str) -> None:
        counts = marts.counted_stations(in_step(city, warehouse.used_stations(city), lambda new: marts.used_stations(new, FILE)))
        warehouse.mart(f"mart_{city}_station_growth").rebuild(marts.growth_from_counts(counts, population))

    # Independent jobs, submitted together: their small last stages overlap.
    with ThreadPoolExecutor(4) as jobs:
        running = [jobs.submit(city_marts, "nyc", True), jobs.submit(city_marts, "london", False),
                   jobs.submit(city_growth, "nyc"), jobs.submit(city_growth, "london")]
    for job in running:
        job.result()
    # Built from the stored daily marts, so the rides are not read again.
    daily = marts.combined_daily(warehouse.mart("mart_nyc_daily_metrics").read(spark),
                                 warehouse.mart("mart_london_daily_metrics").read(spark))
    warehouse.mart("mart_daily_metrics_long").rebuild(marts.metrics_long(daily))


def refresh(spark: SparkSession, warehouse: Warehouse, population: DataFrame,
            stored_staging: bool = False, on_duplicates: str = "error") -> None:
    if stored_staging:
        refresh_staging(spark, warehouse, on_duplicates)
    refresh_rides(spark, warehouse, stored_staging, on_duplicates)
    refresh_marts(spark, warehouse, population)


def register_views(spark: SparkSession, warehouse: Warehouse) -> None:
    """Temp views under the relation names, for plain SQL over the warehouse."""
    for source in staging.MODELS:
        warehouse.raw(specs.get(source)).read(spark).createOrReplaceTempView(f"raw_{source}")
        staged(spark, warehouse, source).createOrReplaceTempView(f"stg_{source}")
    for name in RIDE_SCHEMAS:
        warehouse.rides(name).read(spark).createOrReplaceTempView(name)
    for name in MART_SCHEMAS:
        warehouse.mart(name).read(spark).createOrReplaceTempView(name)
