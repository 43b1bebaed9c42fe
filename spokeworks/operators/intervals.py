"""Joins of days with dated intervals by bins: an equi-join on the bin, and the exact check after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Days of a bin. An interval takes a row per bin that it touches.
BIN = 64


def _bin(day: Column | str) -> Column:
    return F.floor(F.unix_date(day) / BIN)


def days_within(days: DataFrame, intervals: DataFrame, day: str = "day", first: str = "first_day", last: str = "last_day") -> DataFrame:
    """Each day with each interval that holds it, both ends included, however many intervals overlap.

    Intervals that end before they begin, or lack an end, hold no day. The two sides share no other column name.
    """
    binned = (intervals.filter(F.col(first) <= F.col(last))
              .withColumn("_bin", F.explode(F.sequence(_bin(first), _bin(last)))))
    return (days.withColumn("_bin", _bin(day)).join(binned, "_bin")
            .filter(F.col(day).between(F.col(first), F.col(last))).drop("_bin"))
