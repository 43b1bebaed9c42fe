from decimal import Decimal

import pytest

from spokeworks.plans import marts
from spokeworks.sources.population import POPULATION, check_unique, read_population, seed_population

RIDES = "location string, start_time timestamp_ntz, duration_seconds decimal(18,6), user_type string, start_station_id string"
PEOPLE = "location string, year bigint, population bigint"


@pytest.fixture
def rides(spark, ts):
    def row(city, start, seconds, user=None, station=None):
        return (city, ts(start), None if seconds is None else Decimal(seconds), user, station)
    return spark.createDataFrame([
        row("nyc", "2019-01-05 10:00:00", "60", "member", "a"),     # Saturday
        row("nyc", "2019-01-05 23:59:59", "-30", "casual", "a"),
        row("nyc", "2019-01-05 10:30:00", None, None, None),
        row("nyc", "2019-01-07 00:00:00", "0.5", "Other", "b"),     # Monday
        row("nyc", "2021-06-01 08:00:00", "10", "member", "a"),     # nothing in 2020
        row("nyc", "2022-01-01 00:00:00", None, "member", None),    # no known station
        row("nyc", "2023-01-01 00:00:00", "1", "member", "c"),
    ], RIDES)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("nyc", 2019, 2000), ("nyc", 2021, 0)], PEOPLE)


def test_daily_metrics(rides, people, ts):
    rows = {r.date: r for r in marts.daily_metrics(rides, people, True).collect()}
    saturday = rows[ts("2019-01-05")]
    assert (saturday.day_type, saturday.total_rides, saturday.member_rides, saturday.casual_rides) == ("weekend", 3, 1, 1)
    assert (saturday.avg_duration_minutes, saturday.total_minutes_biked) == (0.25, 0.5)
    assert saturday.rides_per_1000 == 1.5
    monday = rows[ts("2019-01-07")]
    assert (monday.day_type, monday.member_rides, monday.casual_rides) == ("weekday", 0, 0)
    zero_people, no_people = rows[ts("2021-06-01")], rows[ts("2022-01-01")]
    assert (zero_people.population, zero_people.rides_per_1000) == (0, None)
    assert (no_people.population, no_people.rides_per_1000) == (None, None)
    assert (no_people.avg_duration_minutes, no_people.total_minutes_biked) == (None, None)


def test_marts_from_hours_equal_marts_from_rides(rides, people):
    hours = marts.hour_totals(rides, True)
    assert sorted(marts.daily_from_hours(hours, people).collect()) == sorted(marts.daily_metrics(rides, people, True).collect())
    assert sorted(marts.hourly_from_hours(hours).collect()) == sorted(marts.hourly_patterns(rides).collect())
    assert sorted(marts.members_from_hours(hours).collect()) == sorted(marts.member_analysis(rides).collect())


def test_member_share_counts_unknown_types_in_the_total(rides, ts):
    rows = {r.month: r.member_percentage for r in marts.member_analysis(rides).collect()}
    assert rows[ts("2019-01-01")] == 25.0


def test_growth_uses_the_previous_row(rides, people):
    rows = {r.year: r for r in marts.station_growth(rides, people).collect()}
    assert [rows[y].station_count for y in (2019, 2021, 2022, 2023)] == [2, 1, 0, 1]
    assert [rows[y].prev_year_count for y in (2019, 2021, 2022, 2023)] == [None, 2, 1, 0]
    assert [rows[y].yoy_growth for y in (2019, 2021, 2022, 2023)] == [None, Decimal("-50.0"), Decimal("-100.0"), None]
    assert rows[2019].stations_per_1000 == 1.0


def test_long_mart_keeps_null_values_except_member_counts(rides, people):
    nyc = marts.daily_metrics(rides, people, True)
    london = marts.daily_metrics(rides.replace("nyc", "london", "location"), people, False)
    long = marts.metrics_long(marts.combined_daily(nyc, london))
    counts = {(r.location, r.metric_name): r["count"] for r in long.groupBy("location", "metric_name").count().collect()}
    assert {m for city, m in counts if city == "nyc"} == set(marts.METRICS)
    assert {m for city, m in counts if city == "london"} == set(marts.METRICS) - set(marts.OPTIONAL_METRICS)
    assert counts["london", "population"] == 5
    assert long.filter("metric_name = 'population' AND metric_value IS NULL AND location = 'nyc'").count() == 2


def test_population_seed(spark, tmp_path):
    seed = seed_population(spark)
    assert seed.count() == len(POPULATION) == 12
    seed.write.option("header", True).csv(str(tmp_path / "p"))
    assert sorted(read_population(spark, str(tmp_path / "p")).collect()) == sorted(seed.collect())
    assert check_unique(seed) is seed
    with pytest.raises(ValueError, match="more than once"):
        check_unique(seed.union(seed.filter("year = 2020")))
