"""Marts over the ride relations.

Each mart is one partial + final aggregation of the rides to days, hours,
months or years; population joins and the year-on-year window come after it,
on rows that number in the thousands. Stored marts carry no order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spokeworks.functions import columns as c

METRICS = ("total_rides", "avg_duration_minutes", "member_rides", "casual_rides",
           "total_minutes_biked", "population", "rides_per_1000")

#: Size of a station sketch: 2 ** 14 slots, off by 0.8 percent in two cases of three.
SKETCH_BITS = 14

#: Metrics that a city may not have; their rows are left out instead of kept as NULL.
OPTIONAL_METRICS = ("member_rides", "casual_rides")


def ride_totals(rides: DataFrame, has_members: bool, place: Sequence[str] = (), **by: Column) -> DataFrame:
    """Ride counts and exact seconds per city and the given calendar columns, and per file where asked."""
    totals = {
        "total_rides": F.count("*"),
        "timed_rides": F.count("duration_seconds"),
        "seconds": c.total_seconds("duration_seconds"),
    }
    if has_members:
        totals["member_rides"] = c.count_where(F.col("user_type") == "member")
        totals["casual_rides"] = c.count_where(F.col("user_type") == "casual")
    return (rides.groupBy("location", *[value.alias(name) for name, value in by.items()], *place)
            .agg(*[value.alias(name) for name, value in totals.items()]))


def hour_totals(rides: DataFrame, has_members: bool, place: Sequence[str] = ()) -> DataFrame:
    """The grain the daily, hourly and monthly marts share: city x day x hour.

    Grouped by DATE: turning it back into midnight is left to the few result rows.
    """
    return ride_totals(rides, has_members, place, date=F.col("start_time").cast("date"),
                       hour_of_day=c.hour_of("start_time"))


def day_totals(rides: DataFrame, has_members: bool) -> DataFrame:
    return ride_totals(rides, has_members, date=F.col("start_time").cast("date"))


def rolled_up(totals: DataFrame, *by: str | Column) -> DataFrame:
    """Totals summed to a coarser grain."""
    measures = [n for n in ("total_rides", "timed_rides", "seconds", *OPTIONAL_METRICS) if n in totals.columns]
    return totals.groupBy(*by).agg(*[F.sum(n).alias(n) for n in measures])


def with_population(rows: DataFrame, population: DataFrame) -> DataFrame:
    """Left join on city and year; an unlisted year leaves the population NULL."""
    return rows.join(population.select("location", "year", "population"), ["location", "year"], "left")


def daily_rates(totals: DataFrame, population: DataFrame) -> DataFrame:
    """Daily mart from totals per city and day."""
    seconds = F.col("seconds").cast("double")
    days = with_population(totals.withColumn("year", c.year_of("date")), population)
    return days.select(
        "location", c.day_of("date").alias("date"), "year",
        c.day_type("date").alias("day_type"),
        "total_rides",
        (seconds / F.nullif(F.col("timed_rides"), F.lit(0)) / 60).alias("avg_duration_minutes"),
        *[n for n in OPTIONAL_METRICS if n in totals.columns],
        (seconds / 60).alias("total_minutes_biked"),
        "population",
        c.per_thousand("total_rides", "population").alias("rides_per_1000"),
    )


def daily_metrics(rides: DataFrame, population: DataFrame, has_members: bool) -> DataFrame:
    return daily_rates(day_totals(rides, has_members), population)


def hourly_patterns(rides: DataFrame) -> DataFrame:
    return (rides.groupBy("location", c.hour_of("start_time").alias("hour_of_day"))
            .agg(F.count("*").alias("ride_count")))


def member_analysis(rides: DataFrame) -> DataFrame:
    return (rides.groupBy("location", c.month_of("start_time").alias("month"))
            .agg(c.percent_where(F.col("user_type") == "member").alias("member_percentage")))


def daily_from_hours(hours: DataFrame, population: DataFrame) -> DataFrame:
    return daily_rates(rolled_up(hours, "location", "date"), population)


def hourly_from_hours(hours: DataFrame) -> DataFrame:
    return hours.groupBy("location", "hour_of_day").agg(F.sum("total_rides").alias("ride_count"))


def members_from_hours(hours: DataFrame) -> DataFrame:
    months = rolled_up(hours, "location", c.month_of("date").alias("month"))
    share = F.col("member_rides").cast("double") * 100.0 / F.col("total_rides").cast("double")
    return months.select("location", "month", share.alias("member_percentage"))


def used_stations(rides: DataFrame, place: Sequence[str] = ()) -> DataFrame:
    """(location, year, start_station_id) in use, and per file where asked."""
    return rides.select("location", c.year_of("start_time").alias("year"), "start_station_id", *place).distinct()


def station_counts(rides: DataFrame) -> DataFrame:
    """Distinct start stations per city and year, exact.

    The distinct is spelled out: rides collapse to (city, year, station) before
    anything moves, so only those triples are shuffled.
    """
    return counted_stations(used_stations(rides))


def counted_stations(used: DataFrame) -> DataFrame:
    """Station counts from triples that may repeat, as they do over files."""
    return (used.select("location", "year", "start_station_id").distinct()
            .groupBy("location", "year").agg(F.count("start_station_id").alias("station_count")))


def station_sketches(rides: DataFrame, place: Sequence[str] = ()) -> DataFrame:
    """(location, year, sketch): the start stations in use as a sketch of fixed size, and per file where asked."""
    return (rides.groupBy("location", c.year_of("start_time").alias("year"), *place)
            .agg(F.hll_sketch_agg("start_station_id", F.lit(SKETCH_BITS)).alias("sketch")))


def approximate_counts(sketches: DataFrame) -> DataFrame:
    """Station counts from sketches that add up over files, as an option: no triple is read again."""
    return (sketches.groupBy("location", "year").agg(F.hll_union_agg("sketch").alias("sketch"))
            .select("location", "year", F.hll_sketch_estimate("sketch").alias("station_count")))


def previous_year(counts: DataFrame) -> DataFrame:
    """Adds the previous listed year's count (not necessarily the calendar year before)."""
    by_year = Window.partitionBy("location").orderBy("year")
    return counts.withColumn("prev_year_count", F.lag("station_count").over(by_year))


def station_growth(rides: DataFrame, population: DataFrame) -> DataFrame:
    return growth_from_counts(station_counts(rides), population)


def growth_from_counts(counts: DataFrame, population: DataFrame) -> DataFrame:
    grown = previous_year(with_population(counts, population))
    return grown.select(
        "location", "year", "station_count", "population",
        c.per_thousand("station_count", "population").alias("stations_per_1000"),
        "prev_year_count",
        c.growth_percent("station_count", "prev_year_count").alias("yoy_growth"),
    )


def combined_daily(with_member_counts: DataFrame, without: DataFrame) -> DataFrame:
    """Daily marts of both cities under the wider column list."""
    absent = F.lit(None).cast("bigint")
    padded = without.withColumns({name: absent for name in OPTIONAL_METRICS})
    return with_member_counts.unionByName(padded)


def metrics_long(daily: DataFrame) -> DataFrame:
    """(date, city, metric, value) in one pass over the daily rows; NULL values are kept
    except for the metrics a city may not have."""
    values = [F.col(m).cast("double").alias(m) for m in METRICS]
    long = (daily.select("date", "location", "year", "day_type", *values)
            .unpivot(["date", "location", "year", "day_type"], list(METRICS),
                     "metric_name", "metric_value"))
    return long.filter(~F.col("metric_name").isin(*OPTIONAL_METRICS) | F.col("metric_value").isNotNull())
