"""The physical plans the library promises."""

import re

import pytest

from spokeworks.operators.increments import unseen_rows
from spokeworks.plans import marts, rides, staging
from spokeworks.plans.warehouse import Warehouse
from spokeworks.samples import SampleRides
from spokeworks.sources import specs
from spokeworks.sources.population import seed_population

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Raw and ride tables of the sample rides."""
    sample, warehouse = SampleRides(spark, FOLDER), Warehouse(str(tmp_path_factory.mktemp("tables")))
    for spec in specs.registered():
        rows = sample.raw(spec.name).selectExpr("*", "current_timestamp() AS ingested_at", "'x' AS landed_id")
        warehouse.raw(spec).append(rows)
    warehouse.rides("int_nyc_rides").append(sample.nyc_rides().selectExpr("*", "'x' AS landed_id"))
    warehouse.mart("mart_nyc_daily_metrics").append(sample.daily("nyc"))
    warehouse.mart("mart_london_daily_metrics").append(sample.daily("london"))
    warehouse.mart("mart_daily_metrics_long").append(sample.long())
    return warehouse


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_mart_reads_three_columns_and_broadcasts_the_seed(spark, stored):
    daily = marts.daily_metrics(stored.rides("int_nyc_rides").read(spark), seed_population(spark), True)
    plan = physical(daily)
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<start_time:timestamp_ntz,user_type:string,duration_seconds:decimal(18,6),location:string>" in plan
    # Rides are aggregated on the map side before the one exchange; the seed is joined after it.
    assert plan.index("BroadcastHashJoin") < plan.index("Exchange hashpartitioning") < plan.index("partial_count")
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Sort" not in plan and "Python" not in plan


def test_ride_path_has_no_python_and_no_shuffle(spark, stored):
    def staged(name):
        return staging.MODELS[name](stored.raw(specs.get(name)).read(spark))
    plan = physical(rides.int_nyc_rides(staged("nyc_modern"), staged("nyc_legacy")))
    assert "Exchange" not in plan and "Python" not in plan
    assert "rideable_type" not in plan and "birth_year" not in plan  # pruned at the scan


def test_increment_prunes_to_the_new_partitions(spark, stored):
    batch = staging.MODELS["nyc_modern"](stored.raw(specs.NYC_MODERN).read(spark))
    held = stored.rides("int_nyc_rides").read(spark).filter("source_file <> 'nyc-modern-2021Q3.csv'")
    fresh = unseen_rows(batch, held)
    assert {r.source_file for r in fresh.select("source_file").distinct().collect()} == {"nyc-modern-2021Q3.csv"}
    assert "dynamicpruning" in physical(fresh)


def test_seen_files_read_no_column(spark, stored):
    plan = physical(stored.rides("int_nyc_rides").read(spark).select("source_file").distinct())
    assert "ReadSchema: struct<>" in plan


def test_station_count_shuffles_distinct_triples(spark, stored):
    plan = physical(marts.station_counts(stored.rides("int_nyc_rides").read(spark)))
    assert "ReadSchema: struct<start_time:timestamp_ntz,start_station_id:string,location:string>" in plan
    scan_side = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "HashAggregate(keys=[location" in scan_side


def test_unpivot_is_one_scan(spark, stored):
    daily = marts.combined_daily(stored.mart("mart_nyc_daily_metrics").read(spark),
                                 stored.mart("mart_london_daily_metrics").read(spark))
    plan = physical(marts.metrics_long(daily))
    assert plan.count("FileScan") == 2 and plan.count("Expand") == 1 and "Exchange" not in plan


def test_report_filters_reach_the_scan(spark, stored):
    from spokeworks.checks.catalog import PERIOD
    from spokeworks.plans import reports
    plan = physical(reports.total_rides(stored.mart("mart_daily_metrics_long").read(spark), "nyc", PERIOD))
    pushed = re.search(r"PushedFilters: \[(.*)\], ReadSchema", plan).group(1)
    for part in ("EqualTo(location,nyc)", "EqualTo(metric_name,total_rides)", "GreaterThanOrEqual(date", "LessThanOrEqual(date"):
        assert part in pushed
