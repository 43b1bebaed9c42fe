"""What bikes and stations do between rides: moves, chains, balances and names over time.

These need the ride before, or a running sum, along all rides of a bike or station. They go through ``ordered``, so
neither a bike nor a station nor a city is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spokeworks.functions import columns as c
from spokeworks.operators import ordered
from spokeworks.plans.explore import station_events

BIKE, STATION = ("location", "bike_id"), ("location", "station_id")
#: Decides between any two rides of a bike that differ.
RIDE_ORDER = ("start_time", "stop_time", "ride_id", "start_station_id", "end_station_id", "source_file")


def bike_moves(rides: DataFrame, parts: int | None = None) -> DataFrame:
    """Every ride of a known bike with what came before it.

    ``idle_seconds`` since the stop of the ride before (signed, NULL where a time is missing), ``moved`` where the
    bike begins at another station than it was left at, and the number of its ``chain``: a chain goes on while each
    ride begins where the one before ended, and a ride with an unknown end breaks it.
    """
    known = rides.filter("bike_id IS NOT NULL").select(*BIKE, *RIDE_ORDER)
    after = ordered.previous(ordered.dealt(known, BIKE, RIDE_ORDER, parts), BIKE, RIDE_ORDER, ("stop_time", "end_station_id"), "before")
    same = F.col("start_station_id") == F.col("before.end_station_id")
    chained = ordered.running(after, BIKE, RIDE_ORDER, F.when(same, 0).otherwise(1), "chain", after_previous=True)
    return chained.select(*BIKE, *RIDE_ORDER, c.duration_seconds("before.stop_time", "start_time").alias("idle_seconds"),
                          F.coalesce(~same, F.lit(False)).alias("moved"), "chain")


def bike_chains(rides: DataFrame, parts: int | None = None) -> DataFrame:
    """Per bike: rides, idle time in all and at most, moves between rides, chains and the rides of the longest."""
    chains = (bike_moves(rides, parts).groupBy(*BIKE, "chain")
              .agg(F.count("*").alias("length"), c.count_where(F.col("moved")).alias("moves"),
                   c.total_seconds("idle_seconds").alias("idle_seconds"), F.max("idle_seconds").alias("longest_idle")))
    return (chains.groupBy(*BIKE).agg(
        F.sum("length").alias("rides"), F.sum("idle_seconds").alias("idle_seconds"), F.max("longest_idle").alias("longest_idle"),
        F.sum("moves").alias("moves"), F.count("*").alias("chains"), F.max("length").alias("longest_chain")))


def station_balance(rides: DataFrame, parts: int | None = None) -> DataFrame:
    """Arrivals less departures since the first event, per station and hour: the lowest and the last of the hour.

    Events of one instant count together. The lowest balance over all hours, turned around, is the number of bikes a
    station must have begun with, or had brought to it.
    """
    events = station_events(rides).select(*STATION, "at", "departed")
    table = ordered.dealt(events, STATION, ("at",), parts, [
        F.sum(1 - 2 * F.col("departed")).alias("change"), F.count("*").alias("events")])
    balanced = ordered.running(table, STATION, ("at",), F.col("change"), "balance")
    hour = [*STATION, F.col("at").cast("date").alias("day"), c.hour_of("at").alias("hour")]
    # An hour that two parts share has a row of each.
    shared = (balanced.groupBy(ordered.PART, *hour)
              .agg(F.sum("events").alias("events"), F.min("balance").alias("lowest"),
                   F.max_by("balance", "at").alias("closing"), F.max("at").alias("at")))
    return (shared.repartition(ordered.parts_of(table), *STATION, "day").groupBy(*STATION, "day", "hour")
            .agg(F.sum("events").alias("events"), F.min("lowest").alias("lowest"), F.max_by("closing", "at").alias("closing")))


def station_history(events: DataFrame, facts: Sequence[str] = ("station_name",), at: str = "at", parts: int | None = None) -> DataFrame:
    """One row for every spell in which a station's facts stay the same, returns to earlier ones included.

    ``events`` has location, station_id, the time and the facts, such as name and place; an event without any fact
    tells nothing. Facts that differ at one instant follow in their own order.
    """
    told, order = events.dropna("all", subset=list(facts)).select(*STATION, at, *facts), (at, *facts)
    table = ordered.dealt(told, STATION, order, parts, [F.count("*").alias("uses")])
    after = ordered.previous(table, STATION, order, facts, "before")
    same: Column = F.col("before").isNotNull()
    for fact in facts:
        same = same & F.col(fact).eqNullSafe(F.col(f"before.{fact}"))
    # Spells of a part first, as a scratch table: the rest is done on these, far fewer rows than events.
    here = Window.partitionBy(ordered.PART, *STATION).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = after.withColumn("within", F.sum(F.when(same, 0).otherwise(1)).over(here))
    spells = ordered.stored(within.groupBy(ordered.PART, *STATION, "within", *facts).agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.sum("uses").alias("uses")))
    # The first spell of a part may go on from the part before; every other one is new.
    spelled = ordered.running(spells, STATION, ("within",), F.when(F.col("within") > 0, 1).otherwise(0), "spell")
    return (spelled.groupBy(*STATION, "spell", *facts)
            .agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("uses").alias("uses")))
