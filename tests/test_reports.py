import datetime as dt

import pytest

from spokeworks.plans import reports
from spokeworks.plans.reports import Period

LONG = "date timestamp_ntz, location string, year bigint, day_type string, metric_name string, metric_value double"
GROWTH = "location string, year bigint, station_count bigint"


@pytest.fixture
def long(spark, ts):
    def row(day, city, metric, value):
        return (ts(day), city, int(day[:4]), "weekday", metric, value)
    return spark.createDataFrame([
        row("2018-12-31", "nyc", "total_rides", 99.0),
        row("2019-01-01", "nyc", "total_rides", 10.0),
        row("2019-01-01", "nyc", "total_minutes_biked", 50.0),
        row("2019-01-03", "nyc", "total_rides", 30.0),
        row("2019-01-03", "nyc", "total_minutes_biked", 50.0),
        row("2020-02-01", "nyc", "total_rides", 5.0),          # rides without minutes
        row("2020-02-01", "nyc", "population", 1000.0),
        row("2025-01-01", "nyc", "total_rides", 7.0),
        row("2020-02-02", "london", "total_rides", 0.0),
        row("2020-02-02", "london", "population", 500.0),
        row("2025-03-01", "london", "total_rides", 8.0),
    ], LONG)


@pytest.fixture
def growth(spark):
    return spark.createDataFrame([("nyc", 2019, 5), ("nyc", 2020, 6)], GROWTH)


ALL = Period(dt.date(2015, 1, 1), dt.date(2030, 1, 1))


def test_date_bounds(long, ts):
    assert reports.latest_date(long, "nyc", reports.LAST_DAY).first()[0] == ts("2020-02-01")
    assert reports.latest_date(long, "london").first()[0] == ts("2025-03-01")
    assert reports.latest_date(long, "paris").first()[0] is None
    assert tuple(reports.date_bounds(long, "nyc", reports.LAST_DAY).first()) == (ts("2019-01-01"), ts("2020-02-01"))
    assert tuple(reports.date_bounds(long, "paris").first()) == (None, ts("2024-12-31"))
    assert tuple(reports.common_date_bounds(long, "nyc", "london").first()) == (ts("2019-01-01"), ts("2020-02-01"))


def test_period_is_clamped(long):
    assert reports.total_rides(long, "nyc", ALL).first()[0] == 45.0
    assert reports.total_rides(long, "nyc", Period(dt.date(2019, 1, 2), dt.date(2019, 1, 3))).first()[0] == 30.0
    assert reports.total_rides(long, "nyc", Period(dt.date(2019, 2, 2), dt.date(2019, 2, 3))).first()[0] is None


def test_average_daily_rides_skips_days_without_rides(long):
    assert reports.average_daily_rides(long, "nyc", ALL).first()[0] == 15.0


def test_absent_minutes_are_null_in_one_average_and_zero_in_the_other(long):
    february = Period(dt.date(2020, 2, 1), dt.date(2020, 2, 28))
    assert reports.average_duration(long, "nyc", february).first()[0] is None
    assert reports.duration_by_month(long, "nyc", february).first().avg_duration == 0.0
    assert reports.average_duration(long, "london", february).first()[0] is None  # no rides at all
    assert reports.duration_by_period(long, february, "yearly").filter("location = 'london'").first().avg_duration is None
    assert reports.average_duration_by_city(long, ALL).filter("location = 'nyc'").first()[1] == pytest.approx(100 / 45)


def test_monthly_trends(long):
    average = reports.rides_by_month(long, "nyc", ALL, "average").collect()
    assert [(r.month, r.year, r.metric_value) for r in average] == [(1, 2019, 20.0), (2, 2020, 5.0)]
    total = reports.rides_by_month(long, "nyc", ALL, "total").collect()
    assert [r.metric_value for r in total] == [40.0, 5.0]


def test_per_capita_uses_the_latest_growth_year(long, growth):
    assert reports.latest_growth_year(growth, ALL).first()[0] == 2020
    assert reports.latest_growth_year(growth, Period(dt.date(2030, 1, 1), dt.date(2031, 1, 1))).first()[0] is None
    rows = {r.location: r for r in reports.per_capita_by_city(long, growth, ALL).collect()}
    assert (rows["nyc"].total_rides, rows["nyc"].population, rows["nyc"].rides_per_1000) == (45.0, 1000.0, 45.0)
    assert rows["london"].rides_per_1000 is None  # zero rides in the period


def test_partial_first_month_is_left_out(spark, ts):
    members = spark.createDataFrame([("nyc", ts("2019-03-01"), 1.0), ("nyc", ts("2019-04-01"), 2.0)],
                                    "location string, month timestamp_ntz, member_percentage double")
    rows = reports.member_trend(members, Period(dt.date(2019, 3, 2), dt.date(2019, 4, 1))).collect()
    assert [r.member_percentage for r in rows] == [2.0]


def test_periods_and_stations(long, growth, ts):
    rows = reports.metric_by_period(long, "total_rides", ALL, "monthly").collect()
    assert [(r.period, r.location, r.metric_value) for r in rows] == [
        (ts("2019-01-01"), "nyc", 40.0), (ts("2020-02-01"), "london", 0.0), (ts("2020-02-01"), "nyc", 5.0)]
    assert [r.metric_value for r in reports.metric_by_period(long, "total_rides", ALL, "yearly").collect()] == [40.0, 0.0, 5.0]
    london = growth.replace("nyc", "london", "location")
    assert [tuple(r) for r in reports.stations_by_city([growth, london], Period(dt.date(2020, 5, 1), dt.date(2020, 6, 1))).collect()] == [
        (2020, "london", 6), (2020, "nyc", 6)]
    assert [r.metric_value for r in reports.stations_by_year(growth, ALL).collect()] == [5, 6]
