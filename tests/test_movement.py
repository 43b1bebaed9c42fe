"""Scans along bikes and stations that span parts, against plain loops."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from spokeworks.operators import ordered
from spokeworks.operators.intervals import days_within
from spokeworks.plans import explore, movement

SCHEMA = ("location string, bike_id string, ride_id string, start_time timestamp_ntz, stop_time timestamp_ntz,"
          " start_station_id string, end_station_id string, start_station_name string, end_station_name string,"
          " duration_seconds decimal(18,6), source_file string")
DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rides(spark):
    """One bike has a third of all rides; times tie, stations and stops are missing."""
    rng, rows = random.Random(7), []
    for i in range(900):
        bike = "hot" if i % 3 == 0 else rng.choice(["b1", "b2", "b3", None, "once" if i == 100 else "b4"])
        start = DAY + dt.timedelta(minutes=rng.randrange(4000))
        stop = None if rng.random() < 0.05 else start + dt.timedelta(seconds=rng.randrange(-60, 4000))
        ends = [rng.choice(["s1", "s2", "s3", None]) for _ in range(2)]
        names = [e and f"{e} {'north' if start.hour < 12 else 'south'}" for e in ends]
        rows.append((rng.choice(["x", "y"]), bike, f"r{i}", start, stop, *ends, *names, None, "f"))
    return rows


@pytest.fixture(scope="module")
def table(spark, rides):
    return spark.createDataFrame(rides, SCHEMA)


def low(value):
    return (value is not None, value)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_bike_chains(table, rides, parts):
    want, groups = {}, {}
    for r in rides:
        if r[1] is not None:
            groups.setdefault(r[:2], []).append(r)
    for key, mine in groups.items():
        mine.sort(key=lambda r: tuple(map(low, (r[3], r[4], r[2], r[5], r[6], r[10]))))
        idle, moves, chains, length, longest = [], 0, 0, 0, 0
        for before, now in zip([None, *mine], mine):
            if before and before[4]:
                idle.append((now[3] - before[4]).total_seconds())
            linked = before is not None and before[6] is not None and before[6] == now[5]
            moves += bool(before and before[6] and now[5] and before[6] != now[5])
            length = length + 1 if linked else 1
            chains += not linked
            longest = max(longest, length)
        want[key] = (len(mine), sum(idle) if idle else None, max(idle, default=None), moves, chains, longest)
    got = {(r.location, r.bike_id): (r.rides, r.idle_seconds and float(r.idle_seconds), r.longest_idle and float(r.longest_idle),
                                     r.moves, r.chains, r.longest_chain) for r in movement.bike_chains(table, parts).collect()}
    assert got == {k: (n, s or s and 0, m, *rest) for k, (n, s, m, *rest) in want.items()}


def events(rides):
    for r in rides:
        for station, name, at, change in ((r[5], r[7], r[3], -1), (r[6], r[8], r[4], 1)):
            if station is not None and at is not None:
                yield r[0], station, name, at, change


@pytest.mark.parametrize("parts", [1, 23])
def test_station_balance(table, rides, parts):
    want, balance, changes = {}, {}, {}
    for location, station, _, at, change in events(rides):
        changes.setdefault((location, station, at), []).append(change)
    for (location, station, at), some in sorted(changes.items()):
        now = balance[location, station] = balance.get((location, station), 0) + sum(some)
        key = (location, station, at.date(), at.hour)
        old = want.get(key, (0, now, now))
        want[key] = (old[0] + len(some), min(old[1], now), now)
    got = {(r.location, r.station_id, r.day, r.hour): (r.events, r.lowest, r.closing) for r in movement.station_balance(table, parts).collect()}
    assert got == want


@pytest.mark.parametrize("parts", [1, 23])
def test_station_history_has_returns(table, rides, parts):
    want, seen = [], {}
    for location, station, name, at, _ in sorted(set(e[:4] + (0,) for e in events(rides)), key=lambda e: (e[0], e[1], e[3], e[2])):
        spells = seen.setdefault((location, station), [])
        if not spells or spells[-1][0] != name:
            spells.append([name, at, at])
        spells[-1][2] = at
    want = sorted((*key, i + 1, *spell) for key, spells in seen.items() for i, spell in enumerate(spells))
    got = movement.station_history(explore.station_events(table), parts=parts).collect()
    assert sorted((r.location, r.station_id, r.spell, r.station_name, r.first_seen, r.last_seen) for r in got) == want
    assert sum(r.uses for r in got) == sum(1 for _ in events(rides)) and len(want) > 20


def test_no_window_over_a_whole_group(spark, plan_of):
    """Windows run over a part of a group, or over one row per part."""
    table = ordered.dealt(spark.range(5000).selectExpr("'one' AS g", "id AS t", "id % 3 AS v"), ["g"], ["t"], 8)
    assert table.select(ordered.PART).distinct().count() == 8
    summed = ordered.running(table, ["g"], ["t"], table["v"], "s")
    assert sorted(r.s for r in summed.collect()) == sorted(sum(i % 3 for i in range(n + 1)) for n in range(5000))
    plan = plan_of(summed)
    for line in plan.split("\n"):
        if "hashpartitioning" in line:
            assert "_part" in line or "_last" in line
    assert "SinglePartition" in plan  # of the borders, a row per part


def test_days_within_overlapping_phases_without_a_nested_loop(spark, plan_of):
    days = spark.range(800).selectExpr("date_add(DATE'1969-06-01', cast(id AS int)) AS day", "id AS rides")
    phases = spark.range(10_000).selectExpr("id AS phase", "date_add(DATE'1969-01-01', cast(id * 7 % 900 AS int)) AS first_day",
                                            "date_add(DATE'1969-01-01', cast(id * 7 % 900 + id % 90 - 2 AS int)) AS last_day")
    found = days_within(days, phases)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    both = {(r.phase, r.day) for r in found.select("phase", "day").collect()}
    first, want = dt.date(1969, 1, 1), set()
    held = {dt.date(1969, 6, 1) + dt.timedelta(i) for i in range(800)}
    for i in range(10_000):
        for k in range(i * 7 % 900, i * 7 % 900 + i % 90 - 1):
            if first + dt.timedelta(k) in held:
                want.add((i, first + dt.timedelta(k)))
    assert both == want


def test_effect_of_phases_without_usual_days_is_unknown(spark):
    rows = [("x", None, "r", dt.datetime(year, 2, 28 + d % 2), None, *[None] * 6) for year, d in ((2023, 0), (2024, 0), (2024, 1), (2024, 1))]
    table = spark.createDataFrame(rows, SCHEMA)
    phases = [("leap", dt.date(2024, 2, 29), dt.date(2024, 2, 29)), ("both", dt.date(2024, 2, 28), dt.date(2024, 2, 29)),
              ("all", dt.date(2000, 1, 1), dt.date(2030, 1, 1)), ("back", dt.date(2024, 3, 1), dt.date(2024, 2, 1))]
    got = {r.phase: (r.rides, r.days, r.usual_rides, r.usual_days, r.effect_percent) for r in explore.phase_effect(table, phases).collect()}
    assert got == {"leap": (2, 1, 1, 1, 100.0), "both": (3, 2, 1, 1, 50.0), "all": (4, 3, None, None, None)}


def test_parts_grow_with_the_rows_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 100)
    rows = spark.range(5000).selectExpr("concat('s', id % 7) AS g", "id % 2500 AS t")
    table = ordered.dealt(rows, ["g"], ["t"], summed=[F.count("*").alias("n")])
    assert ordered.parts_of(table) > 40  # the session has 4 partitions
    sizes = [r["count"] for r in table.groupBy(ordered.PART).count().collect()]
    assert max(sizes) <= 300 and table.agg(F.sum("n")).first()[0] == 5000
    summed = ordered.running(table, ["g"], ["t"], F.col("n"), "s")
    assert summed.rdd.getNumPartitions() == ordered.parts_of(table)
    ends = {r.g: r.s for r in summed.groupBy("g").agg(F.max("s").alias("s")).collect()}
    assert ends == {r.g: r["count"] for r in rows.groupBy("g").count().collect()}


def test_spells_over_parts_are_added_up_from_spells(spark, plan_of):
    events = spark.range(400).selectExpr("'nyc' AS location", "'a' AS station_id", "timestamp_micros(id * 1000000) AS at",
                                         "CASE WHEN id < 100 OR id >= 250 THEN 'x' ELSE 'y' END AS station_name")
    found = movement.station_history(events, parts=8)
    assert sorted((r.spell, r.station_name, r.uses) for r in found.collect()) == [(1, "x", 100), (2, "y", 150), (3, "x", 150)]
    assert "_before" not in plan_of(found)  # what is left to do is done on stored spells, not on events
