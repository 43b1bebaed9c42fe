"""Time the headline jobs and queries; prints one JSON line.

Builds (CSV load, rides, marts) are timed once on empty targets, after a
warm-up on the smallest folder next to the benchmark's. Marts and reports are the
median of three warm runs: marts over the stored rides, reports over the stored
marts, as a dashboard would ask for them.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import tempfile
import time

from pyspark.sql import functions as F

from spokeworks.checks.catalog import PERIOD
from spokeworks.operators import increments
from spokeworks.plans import explore, load, marts, refresh, reports, rides
from spokeworks.plans.warehouse import Warehouse
from spokeworks.samples import SampleRides
from spokeworks.session import build_session, scratch_path
from spokeworks.sources.population import seed_population

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def timed(work) -> float:
    began = time.perf_counter()
    work()
    return time.perf_counter() - began


def fetched(build) -> None:
    build().toArrow()


def drained(build) -> None:
    build().write.format("noop").mode("overwrite").save()


def builds(spark, warehouse: Warehouse, sample: SampleRides) -> dict[str, float]:
    landed = sample.write_landing(scratch_path(spark, "bench-landing"))

    def staged(name):
        return refresh.staged(spark, warehouse, name)

    population = seed_population(spark)
    return {
        "s18_load_all": timed(lambda: load.load_all(spark, warehouse, landed)),
        "k5_build_nyc_rides": timed(lambda: increments.append_unseen(
            spark, rides.int_nyc_rides(staged("nyc_modern"), staged("nyc_legacy")), warehouse.rides("int_nyc_rides"))),
        # The sample repeats ride ids on purpose, so a first load keeps them.
        "k6_build_london_rides": timed(lambda: increments.replace_by_key(
            spark, rides.int_london_rides(staged("london_modern"), staged("london_legacy")),
            warehouse.rides("int_london_rides"), ["ride_id"], on_duplicates="keep")),
        "k7_k14_build_marts": timed(lambda: refresh.refresh_marts(spark, warehouse, population)),
    }


def increment(spark, warehouse: Warehouse) -> dict[str, float]:
    """Timed last: a fifth of the rides again under new objects, each key once, so that every one replaces a ride."""
    def staged(name):
        return refresh.staged(spark, warehouse, name)

    def again(one_in: int, mark: str):
        return (rides.int_london_rides(staged("london_modern"), staged("london_legacy"))
                .dropDuplicates(["ride_id"]).filter(f"hash(ride_id) % {one_in} = 0")
                .withColumn("landed_id", F.concat("landed_id", F.lit(mark))))

    def replace(batch):
        increments.replace_by_key(spark, batch, warehouse.rides("int_london_rides"), ["ride_id"], on_duplicates="error")

    return {
        "s25_keyed_increment": timed(lambda: replace(again(5, "b"))),
        "s25_small_increment": timed(lambda: replace(again(20_000, "c"))),
        "k7_k14_refresh_marts": timed(lambda: refresh.refresh_marts(spark, warehouse, seed_population(spark))),
    }


def queries(spark, warehouse: Warehouse) -> dict:
    population = seed_population(spark)

    def ride(city):
        return warehouse.rides(f"int_{city}_rides").read(spark)

    def mart(name):
        return warehouse.mart(name).read(spark)

    def long():
        return mart("mart_daily_metrics_long")

    return {
        "k7_mart_nyc_daily_metrics": (drained, lambda: marts.daily_metrics(ride("nyc"), population, True)),
        "k8_mart_london_daily_metrics": (drained, lambda: marts.daily_metrics(ride("london"), population, False)),
        "k9_mart_nyc_hourly_patterns": (drained, lambda: marts.hourly_patterns(ride("nyc"))),
        "k10_mart_london_hourly_patterns": (drained, lambda: marts.hourly_patterns(ride("london"))),
        "k11_mart_nyc_member_analysis": (drained, lambda: marts.member_analysis(ride("nyc"))),
        "k12_mart_nyc_station_growth": (drained, lambda: marts.station_growth(ride("nyc"), population)),
        "k13_mart_london_station_growth": (drained, lambda: marts.station_growth(ride("london"), population)),
        "k14_mart_daily_metrics_long": (drained, lambda: marts.metrics_long(marts.combined_daily(
            mart("mart_nyc_daily_metrics"), mart("mart_london_daily_metrics")))),
        "e6_station_metrics": (drained, lambda: explore.station_metrics(ride("nyc"))),
        "e7_routes": (drained, lambda: explore.routes(ride("nyc"))),
        "e9_weekday_segments": (drained, lambda: explore.weekday_segments(ride("nyc"))),
        "d3_common_date_bounds": (fetched, lambda: reports.common_date_bounds(long(), "nyc", "london")),
        "d8_per_capita_by_city": (fetched, lambda: reports.per_capita_by_city(long(), mart("mart_nyc_station_growth"), PERIOD)),
        "d9_average_duration_by_city": (fetched, lambda: reports.average_duration_by_city(long(), PERIOD)),
        "d10_total_rides": (fetched, lambda: reports.total_rides(long(), "nyc", PERIOD)),
        "d11_average_daily_rides": (fetched, lambda: reports.average_daily_rides(long(), "nyc", PERIOD)),
        "d13_average_rides_by_month": (fetched, lambda: reports.rides_by_month(long(), "nyc", PERIOD, "average")),
        "d15_duration_by_month": (fetched, lambda: reports.duration_by_month(long(), "nyc", PERIOD)),
        "d16_rides_by_hour": (fetched, lambda: reports.rides_by_hour(mart("mart_nyc_hourly_patterns"))),
        "d17_member_trend": (fetched, lambda: reports.member_trend(mart("mart_nyc_member_analysis"), PERIOD)),
        "d18_stations_by_year": (fetched, lambda: reports.stations_by_year(mart("mart_london_station_growth"), PERIOD)),
        "d19_rides_by_period": (fetched, lambda: reports.metric_by_period(long(), "total_rides", PERIOD, "monthly")),
        "d20_per_capita_by_period": (fetched, lambda: reports.metric_by_period(long(), "rides_per_1000", PERIOD, "monthly")),
        "d21_duration_by_period": (fetched, lambda: reports.duration_by_period(long(), PERIOD, "monthly")),
        "d22_stations_by_city": (fetched, lambda: reports.stations_by_city(
            [mart("mart_nyc_station_growth"), mart("mart_london_station_growth")], PERIOD)),
    }


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spokeworks-bench-")})
    spark.sparkContext.setLogLevel("ERROR")

    smallest = pathlib.Path(SF_DIR).parent / "sf0.001"
    warm = str(smallest) if smallest.is_dir() else SF_DIR
    trial = Warehouse(scratch_path(spark, "bench-warm"))
    builds(spark, trial, SampleRides(spark, warm))
    increment(spark, trial)

    warehouse = Warehouse(scratch_path(spark, "bench"))
    seconds = builds(spark, warehouse, SampleRides(spark, SF_DIR))
    for name, (consume, build) in queries(spark, warehouse).items():
        consume(build)
        seconds[name] = statistics.median(timed(lambda: consume(build)) for _ in range(RUNS))
    rows = sum(warehouse.rides(f"int_{city}_rides").read(spark).count() for city in ("nyc", "london"))
    seconds |= increment(spark, warehouse)
    print(json.dumps({
        "metric": "total seconds of ride, mart and report queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": {n: round(v, 3) for n, v in seconds.items()},
        "sf": pathlib.Path(SF_DIR).name.removeprefix("sf"), "rides": rows, "cpus": int(CPUS)}))


if __name__ == "__main__":
    sys.exit(main())
