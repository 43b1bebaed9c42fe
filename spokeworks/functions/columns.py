"""Ride-level and metric-level column expressions.

Everything here is a built-in expression, so the ride path stays inside
whole-stage code generation. Wall-clock truncation goes through DATE because
``date_trunc`` turns a TIMESTAMP_NTZ into a zoned TIMESTAMP.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- ride level ---------------------------------------------------------------

def duration_seconds(start: Column | str, stop: Column | str) -> Column:
    """Signed seconds from start to stop, microseconds kept, as decimal(18,6)."""
    elapsed = _col(stop) - _col(start)
    return elapsed.cast("interval second").cast("decimal(18,6)")


def second_stamp(ts: Column | str) -> Column:
    """``yyyyMMddHHmmss`` of a wall-clock time, fractions dropped.

    Put together from its parts: ``date_format`` would take the time through the
    session zone and move it where that zone skips an hour.
    """
    t = _col(ts)
    day = F.year(t) * F.lit(10_000).cast("bigint") + F.month(t) * 100 + F.day(t)
    return (day * 1_000_000 + F.hour(t) * 10_000 + F.minute(t) * 100 + F.second(t)).cast("string")


def legacy_ride_key(bike: Column | str, station: Column | str,
                    start: Column | str, stop: Column | str) -> Column:
    """Key for rides that carry none of their own; NULL as soon as one part is NULL."""
    return F.concat(
        F.lit("legacy_"), _col(bike), F.lit("_"), _col(station), F.lit("_"),
        second_stamp(start), F.lit("_"), second_stamp(stop),
    )


#: Legacy rider type -> current name; any other value is kept.
USER_TYPES = {"Subscriber": "member", "Customer": "casual"}


def current_user_type(user_type: Column | str) -> Column:
    source = _col(user_type)
    renamed = None
    for old, new in USER_TYPES.items():
        renamed = F.when(source == old, new) if renamed is None else renamed.when(source == old, new)
    return renamed.otherwise(source)


# -- calendar -----------------------------------------------------------------

def day_of(ts: Column | str) -> Column:
    """Midnight of the day, still a wall-clock timestamp."""
    return _col(ts).cast("date").cast("timestamp_ntz")


def month_of(ts: Column | str) -> Column:
    return F.trunc(_col(ts).cast("date"), "month").cast("timestamp_ntz")


def year_start_of(ts: Column | str) -> Column:
    return F.trunc(_col(ts).cast("date"), "year").cast("timestamp_ntz")


def year_of(ts: Column | str) -> Column:
    return F.year(_col(ts)).cast("bigint")


def month_number(ts: Column | str) -> Column:
    return F.month(_col(ts)).cast("bigint")


def hour_of(ts: Column | str) -> Column:
    return F.hour(_col(ts)).cast("bigint")


def iso_weekday(ts: Column | str) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return (F.weekday(_col(ts)) + 1).cast("bigint")


def day_type(ts: Column | str) -> Column:
    return F.when(iso_weekday(ts) < 6, "weekday").otherwise("weekend")


# -- rates --------------------------------------------------------------------

def per_thousand(amount: Column | str, population: Column | str) -> Column:
    """Amount per 1,000 residents; NULL for an unknown or zero population."""
    return _col(amount).cast("double") / F.nullif(_col(population), F.lit(0)) * 1000


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that answers NULL instead of failing on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def growth_percent(current: Column | str, previous: Column | str) -> Column:
    """Change against the previous value in percent, one decimal, halves away from zero."""
    now = _col(current).cast("decimal(18,0)")
    before = F.nullif(_col(previous), F.lit(0)).cast("decimal(18,0)")
    return F.round((now - before) * 100 / before, 1).cast("decimal(18,1)")


# -- aggregates ---------------------------------------------------------------

def total_seconds(seconds: Column | str) -> Column:
    """Exact sum of decimal seconds.

    Whole seconds and microseconds are summed as two longs: that is about half
    the cost of a decimal accumulator per ride, and neither can overflow before
    10**12 rides fall into one group.
    """
    value = _col(seconds)
    whole = value.cast("bigint")
    micros = (value * 1_000_000).cast("bigint") % 1_000_000
    return (F.sum(whole).cast("decimal(20,0)")
            + F.sum(micros).cast("decimal(20,0)") * F.lit(Decimal("0.000001")))


def count_where(condition: Column) -> Column:
    """sum(case when ... then 1 else 0 end): NULL conditions count as zero."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def percent_where(condition: Column) -> Column:
    return F.count_if(condition).cast("double") * 100.0 / F.count("*").cast("double")


def sum_where(value: Column | str, condition: Column) -> Column:
    """Filtered sum: NULL when no row qualifies."""
    return F.sum(F.when(condition, _col(value)))


def sum_else_zero(value: Column | str, condition: Column) -> Column:
    """CASE ... ELSE 0 sum: 0 when rows exist but none qualifies."""
    return F.sum(F.when(condition, _col(value)).otherwise(F.lit(0.0)))


# -- ranges -------------------------------------------------------------------

def clamp(start: dt.date, end: dt.date, low: dt.date, high: dt.date) -> tuple[dt.date, dt.date]:
    return max(start, low), min(end, high)


def wall_clock(day: dt.date) -> Column:
    return F.lit(day).cast("timestamp_ntz")
