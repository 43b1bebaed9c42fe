from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spokeworks.functions import columns as c
from spokeworks.functions.parsing import blank_to_null, parse_long, parse_timestamp
from spokeworks.operators.quality import is_valid


def one(spark, expression, schema, *values):
    return spark.createDataFrame([values], schema).select(expression.alias("v")).first().v


TIMES = "a timestamp_ntz, b timestamp_ntz"


@pytest.mark.parametrize("start, stop, seconds", [
    ("2023-01-01 10:00:00", "2023-01-01 10:00:00", "0"),
    ("2023-01-01 10:00:00", "2023-01-01 09:59:30", "-30"),
    ("2023-12-31 23:59:00", "2024-01-01 00:01:00", "120"),
    ("2023-01-01 10:00:00", "2023-01-01 10:00:01.250001", "1.250001"),
])
def test_duration_keeps_sign_and_fraction(spark, ts, start, stop, seconds):
    assert one(spark, c.duration_seconds("a", "b"), TIMES, ts(start), ts(stop)) == Decimal(seconds)


def test_duration_of_an_open_ride_is_null(spark, ts):
    assert one(spark, c.duration_seconds("a", "b"), TIMES, ts("2023-01-01 10:00:00"), None) is None


def test_legacy_key_drops_fractions_and_propagates_null(spark, ts):
    key = c.legacy_ride_key("bike", "station", "a", "b")
    schema = "bike string, station string, " + TIMES
    start, stop = ts("2019-06-01 00:00:05.900"), ts("2019-06-01 00:10:00")
    assert one(spark, key, schema, "7", "72", start, stop) == "legacy_7_72_20190601000005_20190601001000"
    assert one(spark, key, schema, "7", None, start, stop) is None
    assert one(spark, key, schema, "7", "72", start, None) is None


@pytest.mark.parametrize("raw, mapped", [
    ("Subscriber", "member"), ("Customer", "casual"), ("Dependent", "Dependent"), ("subscriber", "subscriber"), (None, None)])
def test_user_types(spark, raw, mapped):
    assert one(spark, c.current_user_type("u"), "u string", raw) == mapped


@pytest.mark.parametrize("day, kind", [
    ("2023-01-01 23:59:59", "weekend"), ("2023-01-02 00:00:00", "weekday"),
    ("2023-01-06 12:00:00", "weekday"), ("2023-01-07 00:00:00", "weekend")])
def test_day_type(spark, ts, day, kind):
    assert one(spark, c.day_type("a"), "a timestamp_ntz", ts(day)) == kind


def test_truncation_ignores_the_session_zone(spark, ts):
    moment = ts("2023-03-26 01:30:00")  # does not exist in London local time
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        row = spark.createDataFrame([(moment,)], "a timestamp_ntz").select(
            c.day_of("a").alias("d"), c.month_of("a").alias("m"), c.year_start_of("a").alias("y"),
            c.hour_of("a").alias("h"), c.second_stamp("a").alias("s")).first()
        parsed = one(spark, parse_timestamp(F.col("t"), ("day_first_minutes",)), "t string", "26/03/2023 01:30")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == (ts("2023-03-26"), ts("2023-03-01"), ts("2023-01-01"), 1, "20230326013000")
    assert parsed == moment


@pytest.mark.parametrize("amount, people, rate", [(10, 2000, 5.0), (10, 0, None), (10, None, None), (0, 10, 0.0)])
def test_per_thousand(spark, amount, people, rate):
    assert one(spark, c.per_thousand("a", "p"), "a bigint, p bigint", amount, people) == rate


@pytest.mark.parametrize("now, before, percent", [
    (110, 100, "10.0"), (90, 100, "-10.0"), (5, 0, None), (5, None, None),
    (1601, 1600, "0.1"),    # 0.0625 -> 0.1
    (2001, 2000, "0.1"),    # 0.05 rounds away from zero
    (1999, 2000, "-0.1"), (4, 3, "33.3"), (0, 7, "-100.0")])
def test_growth_percent(spark, now, before, percent):
    value = one(spark, c.growth_percent("a", "b"), "a bigint, b bigint", now, before)
    assert value == (None if percent is None else Decimal(percent))


def test_total_seconds_is_exact(spark):
    rows = [(Decimal("0.1"),)] * 10 + [(Decimal("-2.5"),), (None,), (Decimal("999999999999.999999"),)]
    total = spark.createDataFrame(rows, "s decimal(18,6)").agg(c.total_seconds("s").alias("v")).first().v
    assert total == Decimal("999999999998.499999")


def test_conditional_aggregates(spark):
    rows = spark.createDataFrame([("member",), ("casual",), (None,), ("Other",)], "u string")
    member = F.col("u") == "member"
    row = rows.agg(c.count_where(member).alias("n"), c.percent_where(member).alias("p")).first()
    assert (row.n, row.p) == (1, 25.0)


@pytest.mark.parametrize("text, layout, expected", [
    ("18/12/2019 14:05", "day_first_minutes", "2019-12-18 14:05:00"),
    ("8/1/2020 4:05", "day_first_minutes", "2020-01-08 04:05:00"),
    ("12/18/2019 14:05", "day_first_minutes", None),
    ("18/12/2019 14:05:09", "day_first_minutes", None),
    ("2023-03-06 14:05", "iso_minutes", "2023-03-06 14:05:00"),
    ("2023-03-06 14:05:10", "iso_minutes", None),
    ("2023-02-30 10:00", "iso_minutes", None),
    ("2021-02-01 00:04:23.123", "iso", "2021-02-01 00:04:23.123"),
    ("6/1/2019 0:05", "month_first", "2019-06-01 00:05:00"),
    ("soon", "iso", None),
])
def test_timestamp_layouts(spark, ts, text, layout, expected):
    value = one(spark, parse_timestamp(F.col("t"), (layout,)), "t string", text)
    assert value == (None if expected is None else ts(expected))


@pytest.mark.parametrize("text, number", [("12", 12), ("1985.0", 1985), ("2.5", 2), ("3.5", 4), ("x", None), (None, None)])
def test_long_parsing(spark, text, number):
    assert one(spark, parse_long(F.col("t")), "t string", text) == number


@pytest.mark.parametrize("text, kept", [("", None), ("NaN", None), ("NA", None), ("null", None), ("Nana", "Nana"), ("0", "0")])
def test_missing_tokens(spark, text, kept):
    assert one(spark, blank_to_null(F.col("t")), "t string", text) == kept


@pytest.mark.parametrize("text, kinds, ok", [
    ("12", ("string",), True), ("a", ("string",), True), ("a", ("bigint",), False), ("1.5", ("double",), True),
    ("2023-01-01 10:00", ("timestamp_ntz",), True), ("soon", ("timestamp_ntz",), False),
    ("soon", ("bigint", "timestamp_ntz"), False), ("5", ("timestamp_ntz", "bigint"), True), (None, ("string",), False)])
def test_typed_value_check(spark, text, kinds, ok):
    assert one(spark, is_valid(F.col("t"), *kinds), "t string", text) is ok
