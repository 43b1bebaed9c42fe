"""Dashboard queries over the marts, as functions of typed parameters.

``long`` is the long metrics mart. A period is (start, end), both inclusive,
clamped to the reporting range. City filters and metric filters are plain
predicates, so they reach the Parquet scan of the mart.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spokeworks.functions import columns as c

#: First and last day the reports cover.
FIRST_DAY = dt.date(2019, 1, 1)
LAST_DAY = dt.date(2024, 12, 31)

DURATION_METRICS = ("total_minutes_biked", "total_rides")


@dataclass(frozen=True)
class Period:
    start: dt.date
    end: dt.date

    def clamped(self) -> Column:
        """Predicate on ``date`` within the reporting range."""
        first, last = c.clamp(self.start, self.end, FIRST_DAY, LAST_DAY)
        return F.col("date").between(c.wall_clock(first), c.wall_clock(last))

    def years(self) -> Column:
        return F.col("year").between(self.start.year, self.end.year)

    def months(self) -> Column:
        """Months that begin within the period: a partial first month is out."""
        return F.col("month").between(c.wall_clock(self.start), c.wall_clock(self.end))


def _city(city: str) -> Column:
    return F.col("location") == city


def _metric(name: str) -> Column:
    return F.col("metric_name") == name


def _true_average() -> Column:
    """Minutes over rides, NULL without minutes or with no rides."""
    return c.ratio(c.sum_where("metric_value", _metric("total_minutes_biked")),
                   c.sum_where("metric_value", _metric("total_rides")))


def _average_or_zero() -> Column:
    """Minutes over rides where absent minutes count as zero."""
    return c.ratio(c.sum_else_zero("metric_value", _metric("total_minutes_biked")),
                   c.sum_else_zero("metric_value", _metric("total_rides")))


# -- date bounds --------------------------------------------------------------

def latest_date(long: DataFrame, city: str, cap: dt.date | None = None) -> DataFrame:
    """Last day with data, optionally no later than the cap; NULL for an unknown city."""
    rows = long.filter(_city(city))
    if cap is not None:
        rows = rows.filter(F.col("date") <= c.wall_clock(cap))
    return rows.agg(F.max("date").alias("max_date"))


def date_bounds(long: DataFrame, city: str, cap: dt.date | None = None) -> DataFrame:
    """(min_date, max_date) of one city; without data the end of the reporting range."""
    wanted = F.col("date") >= c.wall_clock(FIRST_DAY)
    rows = long.filter(_city(city))
    if cap is not None:
        rows = rows.filter(F.col("date") <= c.wall_clock(cap))
    return rows.agg(
        F.min(F.when(wanted, F.col("date"))).alias("min_date"),
        F.coalesce(F.max("date"), c.wall_clock(LAST_DAY)).alias("max_date"),
    )


def common_date_bounds(long: DataFrame, capped_city: str, other_city: str) -> DataFrame:
    """First day in range of any city, and the earlier of the two cities' last days."""
    days = long.select("location", "date").groupBy("location", "date").agg(F.lit(1).alias("one"))
    capped_last = F.max(F.when(_city(capped_city) & (F.col("date") <= c.wall_clock(LAST_DAY)), F.col("date")))
    other_last = F.max(F.when(_city(other_city), F.col("date")))
    first = F.min(F.when(F.col("date") >= c.wall_clock(FIRST_DAY), F.col("date")))
    bounds = days.agg(
        first.alias("first"),
        F.least(F.coalesce(capped_last, c.wall_clock(LAST_DAY)),
                F.coalesce(other_last, c.wall_clock(LAST_DAY))).alias("max_date"))
    return bounds.select(F.when(F.col("first") <= F.col("max_date"), F.col("first")).alias("min_date"),
                         "max_date")


# -- comparison figures -------------------------------------------------------

def latest_growth_year(growth: DataFrame, period: Period) -> DataFrame:
    return growth.filter(period.years()).agg(F.max("year").alias("latest_year"))


def population_in_latest_year(long: DataFrame, growth: DataFrame, period: Period) -> DataFrame:
    """Per city, for the latest year of the leading city's growth mart."""
    latest = latest_growth_year(growth, period)
    return (long.filter(_metric("population"))
            .filter(F.col("year") == latest.scalar())
            .groupBy("location").agg(F.max("metric_value").alias("population")))


def rides_by_city(long: DataFrame, period: Period) -> DataFrame:
    return (long.filter(_metric("total_rides") & period.clamped())
            .groupBy("location").agg(F.sum("metric_value").alias("total_rides")))


def per_capita_by_city(long: DataFrame, growth: DataFrame, period: Period) -> DataFrame:
    """Rides of the whole period per 1,000 residents of the latest year."""
    rides = rides_by_city(long, period)
    residents = population_in_latest_year(long, growth, period)
    return (rides.join(residents, "location", "full_outer")
            .select("location", "total_rides", "population",
                    (c.ratio(F.nullif(F.col("total_rides"), F.lit(0.0)), F.col("population")) * 1000)
                    .alias("rides_per_1000")))


def average_duration_by_city(long: DataFrame, period: Period) -> DataFrame:
    return (long.filter(F.col("metric_name").isin(*DURATION_METRICS) & period.clamped())
            .groupBy("location").agg(_true_average().alias("avg_ride_duration_minutes")))


# -- one city -----------------------------------------------------------------

def total_rides(long: DataFrame, city: str, period: Period) -> DataFrame:
    return (long.filter(_city(city) & _metric("total_rides") & period.clamped())
            .agg(F.sum("metric_value").alias("total_rides")))


def average_daily_rides(long: DataFrame, city: str, period: Period) -> DataFrame:
    """Mean over the days that have rides."""
    days = (long.filter(_city(city) & _metric("total_rides") & period.clamped())
            .groupBy("date").agg(F.sum("metric_value").alias("daily_rides")))
    return days.agg(F.avg("daily_rides").alias("avg_daily_rides"))


def average_duration(long: DataFrame, city: str, period: Period) -> DataFrame:
    return (long.filter(_city(city) & F.col("metric_name").isin(*DURATION_METRICS) & period.clamped())
            .agg(_true_average().alias("avg_ride_duration_minutes")))


def rides_by_month(long: DataFrame, city: str, period: Period, aggregation: str = "average") -> DataFrame:
    """Month x year trend of daily rides: their average or their total."""
    combine = {"average": F.avg, "total": F.sum}[aggregation]
    return (long.filter(_city(city) & _metric("total_rides") & period.clamped())
            .groupBy(c.month_number("date").alias("month"), "year")
            .agg(combine("metric_value").alias("metric_value"))
            .orderBy("month", "year"))


def duration_by_month(long: DataFrame, city: str, period: Period) -> DataFrame:
    return (long.filter(_city(city) & F.col("metric_name").isin(*DURATION_METRICS) & period.clamped())
            .groupBy(c.month_number("date").alias("month"), "year")
            .agg(_average_or_zero().alias("avg_duration"))
            .orderBy("month", "year"))


def rides_by_hour(hourly: DataFrame) -> DataFrame:
    """All data, whatever the period."""
    return hourly.select("hour_of_day", "ride_count").orderBy("hour_of_day")


def member_trend(members: DataFrame, period: Period) -> DataFrame:
    return members.filter(period.months()).select("month", "member_percentage").orderBy("month")


def stations_by_year(growth: DataFrame, period: Period) -> DataFrame:
    return (growth.filter(period.years())
            .select("year", F.col("station_count").alias("metric_value")).orderBy("year"))


# -- both cities --------------------------------------------------------------

def _period_start(aggregation: str) -> Column:
    return {"monthly": c.month_of, "yearly": c.year_start_of}[aggregation]("date").alias("period")


def metric_by_period(long: DataFrame, metric: str, period: Period, aggregation: str = "monthly") -> DataFrame:
    """Sum of a daily metric: ``total_rides`` or the daily rate ``rides_per_1000``."""
    return (long.filter(_metric(metric) & period.clamped())
            .groupBy(_period_start(aggregation), "location")
            .agg(F.sum("metric_value").alias("metric_value"))
            .orderBy("period", "location"))


def duration_by_period(long: DataFrame, period: Period, aggregation: str = "monthly") -> DataFrame:
    return (long.filter(F.col("metric_name").isin(*DURATION_METRICS) & period.clamped())
            .groupBy(_period_start(aggregation), "location")
            .agg(_average_or_zero().alias("avg_duration"))
            .orderBy("period", "location"))


def stations_by_city(growths: list[DataFrame], period: Period) -> DataFrame:
    both = growths[0]
    for other in growths[1:]:
        both = both.unionByName(other)
    return (both.filter(period.years()).select("year", "location", "station_count")
            .orderBy("year", "location"))
