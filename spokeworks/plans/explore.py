"""Rides seen by station, route, bike, weekday and season.

Every relation is one partial + final aggregation of the rides; ranks and shares are taken on its
result. Durations are exact seconds (see ``columns.total_seconds``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spokeworks.functions import columns as c
from spokeworks.operators.intervals import days_within

#: Dated phases: (phase, first_day, last_day), both days included.
Phases = DataFrame | Sequence[tuple[str, dt.date, dt.date]]

#: Kilometres, for distances on the sphere.
EARTH_RADIUS = 6371.0
#: First hours of the parts of a day.
DAY_PARTS = (("night", 0), ("morning", 6), ("midday", 10), ("evening", 16), ("late", 20))


def _minutes() -> Column:
    return c.total_seconds("duration_seconds").cast("double") / F.nullif(F.count("duration_seconds"), F.lit(0)) / 60


def with_date_fields(rides: DataFrame) -> DataFrame:
    """Rides with the fields that marts derive from the start, taken once."""
    return rides.withColumns({
        "ride_date": F.col("start_time").cast("date"), "year": c.year_of("start_time"),
        "month": c.month_number("start_time"), "hour": c.hour_of("start_time"),
        "weekday": c.iso_weekday("start_time"), "day_type": c.day_type("start_time")})


def station_events(rides: DataFrame) -> DataFrame:
    """Both ends of every ride: (location, station_id, station_name, at, departed, seconds).

    One pass; an end without a station is left out, and so is an arrival without a time.
    """
    def end(kind: str, at: str, departed: int) -> Column:
        return F.struct(F.col(f"{kind}_station_id").alias("station_id"), F.col(f"{kind}_station_name").alias("station_name"),
                        F.col(at).alias("at"), F.lit(departed).alias("departed"))

    ends = F.array(end("start", "start_time", 1), end("end", "stop_time", 0))
    return (rides.select("location", "duration_seconds", F.explode(ends).alias("e"))
            .select("location", "e.*", F.when(F.col("e.departed") == 1, F.col("duration_seconds")).alias("duration_seconds"))
            .filter("station_id IS NOT NULL AND at IS NOT NULL"))


def station_metrics(rides: DataFrame) -> DataFrame:
    """Departures, arrivals, their difference and the average minutes of departures, per station and year."""
    return (station_events(rides).groupBy("location", c.year_of("at").alias("year"), "station_id")
            .agg(F.sum("departed").alias("departures"), F.sum(1 - F.col("departed")).alias("arrivals"),
                 _minutes().alias("avg_minutes"))
            .withColumn("net_flow", F.col("arrivals") - F.col("departures")))


def top_stations(metrics: DataFrame, k: int) -> DataFrame:
    """The k stations with most departures per city and year; ties by station."""
    order = Window.partitionBy("location", "year").orderBy(F.desc("departures"), "station_id")
    return metrics.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def station_dimension(rides: DataFrame) -> DataFrame:
    """One row per station: the name it bore last (of equal times, the last by name), first and last use."""
    return (station_events(rides).groupBy("location", "station_id")
            .agg(F.max(F.struct("at", "station_name")).alias("latest"), F.min("at").alias("first_used"))
            .select("location", "station_id", F.col("latest.station_name").alias("station_name"), "first_used",
                    F.col("latest.at").alias("last_used")))


def kilometres(lat1: str, lng1: str, lat2: str, lng2: str) -> Column:
    """Great-circle distance of two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    half = (F.pow(F.sin((b - a) / 2), F.lit(2.0))
            + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), F.lit(2.0)))
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(half))


def routes(rides: DataFrame) -> DataFrame:
    """Rides and average minutes per pair of stations, no self-join."""
    return (rides.filter("start_station_id IS NOT NULL AND end_station_id IS NOT NULL")
            .groupBy("location", "start_station_id", "end_station_id")
            .agg(F.count("*").alias("rides"), _minutes().alias("avg_minutes")))


def route_distances(rides: DataFrame) -> DataFrame:
    """Length in km of the pairs of stations whose places are known, by their outermost coordinates."""
    places = {f"{end}_{axis}": F.max(f"{end}_{axis}") for end in ("start", "end") for axis in ("latitude", "longitude")}
    return (rides.filter("start_station_id IS NOT NULL AND end_station_id IS NOT NULL")
            .groupBy("location", "start_station_id", "end_station_id").agg(*[v.alias(n) for n, v in places.items()])
            .select("location", "start_station_id", "end_station_id",
                    kilometres("start_latitude", "start_longitude", "end_latitude", "end_longitude").alias("km")))


def grid_cells(rides: DataFrame, per_degree: int = 100) -> DataFrame:
    """Departures per cell of 1 / ``per_degree`` degrees; cells are numbered from the south and west."""
    cell = lambda name: F.floor(F.col(name) * per_degree)
    return (rides.filter("start_latitude IS NOT NULL AND start_longitude IS NOT NULL")
            .groupBy("location", cell("start_latitude").alias("north"), cell("start_longitude").alias("east"))
            .agg(F.count("*").alias("departures")))


def bike_use(rides: DataFrame) -> DataFrame:
    """Rides, minutes and days in use per bike."""
    return (rides.filter("bike_id IS NOT NULL").groupBy("location", "bike_id")
            .agg(F.count("*").alias("rides"), _minutes().alias("avg_minutes"),
                 F.min("start_time").alias("first_ride"), F.max("start_time").alias("last_ride")))


def weekday_segments(rides: DataFrame) -> DataFrame:
    """Rides and average minutes per city, weekday and part of the day."""
    hour, part = c.hour_of("start_time"), F.lit(DAY_PARTS[0][0])
    for name, first in DAY_PARTS[1:]:
        part = F.when(hour >= first, name).otherwise(part)
    return (rides.groupBy("location", c.iso_weekday("start_time").alias("weekday"), part.alias("day_part"))
            .agg(F.count("*").alias("rides"), _minutes().alias("avg_minutes")))


def seasonal_index(rides: DataFrame) -> DataFrame:
    """Rides of a calendar month over those of an average month of its city, from whole counts."""
    months = (rides.groupBy("location", c.year_of("start_time").alias("year"), c.month_number("start_time").alias("month"))
              .agg(F.count("*").alias("rides")))
    by_month = months.groupBy("location", "month").agg(F.sum("rides").alias("rides"), F.count("*").alias("years"))
    city = Window.partitionBy("location")
    average = F.sum("rides").over(city).cast("double") / F.sum("years").over(city)
    return by_month.select("location", "month", "rides", "years",
                           (F.col("rides").cast("double") / F.col("years") / average).alias("seasonal_index"))


def _day_counts(rides: DataFrame) -> DataFrame:
    return (rides.groupBy("location", F.col("start_time").cast("date").alias("day"))
            .agg(F.count("*").alias("rides"), F.count("duration_seconds").alias("timed"),
                 c.total_seconds("duration_seconds").alias("seconds")))


def _listed(spark: SparkSession, phases: Phases) -> DataFrame:
    if isinstance(phases, DataFrame):
        return phases.select("phase", "first_day", "last_day")
    return spark.createDataFrame(list(phases), "phase string, first_day date, last_day date")


def phase_metrics(rides: DataFrame, phases: Phases) -> DataFrame:
    """Rides, days and average minutes per city within dated phases, which may overlap.

    Rides become days first; days meet phases by bins, so neither side needs to be small.
    """
    return (days_within(_day_counts(rides), _listed(rides.sparkSession, phases))
            .groupBy("location", "phase")
            .agg(F.sum("rides").alias("rides"), F.count("*").alias("days"),
                 (F.sum("seconds").cast("double") / F.nullif(F.sum("timed"), F.lit(0)) / 60).alias("avg_minutes")))


def phase_effect(rides: DataFrame, phases: Phases) -> DataFrame:
    """What a phase changed: its rides a day against those of the same calendar days of other years.

    A phase is moved by whole years over all the years there are; days of the phase itself never count as usual
    ones, and a day that two moves reach counts once. ``effect_percent`` is NULL where other years have no such day.
    """
    days = _day_counts(rides).select("location", "day", "rides")
    span = days.agg(F.year(F.min("day")).alias("first"), F.year(F.max("day")).alias("last")).first()
    listed = _listed(rides.sparkSession, phases)
    shifts = F.sequence(F.lit(span["first"]) - F.year("last_day"), F.lit(span["last"]) - F.year("first_day"))
    moved = (listed.filter("first_day <= last_day").withColumn("shift", F.explode(shifts)).filter("shift <> 0")
             .select("phase", F.col("first_day").alias("own_first"), F.col("last_day").alias("own_last"),
                     F.expr("add_months(first_day, 12 * shift)").alias("first_day"),
                     F.expr("add_months(last_day, 12 * shift)").alias("last_day")))
    usual = (days_within(days, moved).filter("day NOT BETWEEN own_first AND own_last")
             .select("location", "phase", "day", "rides").distinct()
             .groupBy("location", "phase").agg(F.sum("rides").alias("usual_rides"), F.count("*").alias("usual_days")))
    own = (days_within(days, listed).groupBy("location", "phase")
           .agg(F.sum("rides").alias("rides"), F.count("*").alias("days")))
    rate = lambda n, of: F.col(n).cast("double") / F.col(of)
    return own.join(usual, ["location", "phase"], "left").withColumn(
        "effect_percent", rate("rides", "days") / rate("usual_rides", "usual_days") * 100 - 100)
