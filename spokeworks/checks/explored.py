"""Queries of the exploring plans next to their SQL; importing this adds them to the catalog."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, functions as F

from spokeworks.checks.catalog import _NAMES, query, shipped
from spokeworks.operators import increments, quality
from spokeworks.plans import explore, movement
from spokeworks.sources import manifest, specs

_MINUTES = "CAST(sum({us}) AS DOUBLE) / CAST(1000000 AS DOUBLE) / nullif(count({us}), 0) / 60"
_AVERAGE = _MINUTES.format(us="us")
PHASES = (("spring", dt.date(2020, 3, 1), dt.date(2020, 6, 30)), ("half", dt.date(2020, 1, 1), dt.date(2020, 7, 15)),
          ("later", dt.date(2021, 4, 1), dt.date(2023, 3, 31)), ("never", dt.date(1990, 1, 1), dt.date(1990, 2, 1)))

_NAMED = """(
  SELECT location, start_time, stop_time, us, start_station_id, start_station_name, end_station_id, end_station_name FROM int_nyc_rides
  UNION ALL
  SELECT location, start_time, stop_time, us, start_station_id, start_station_name, end_station_id, end_station_name FROM int_london_rides)"""
_USED = f"""(
  SELECT location, start_station_id AS station_id, start_station_name AS station_name, start_time AS used, 1 AS departed, us
  FROM {_NAMED} WHERE start_station_id IS NOT NULL AND start_time IS NOT NULL
  UNION ALL SELECT location, end_station_id, end_station_name, stop_time, 0, NULL
  FROM {_NAMED} WHERE end_station_id IS NOT NULL AND stop_time IS NOT NULL)"""
_STATIONS = f"""(
  SELECT location, CAST(year(used) AS BIGINT) AS year, station_id, CAST(sum(departed) AS BIGINT) AS departures,
    CAST(count(*) - sum(departed) AS BIGINT) AS arrivals, {_AVERAGE} AS avg_minutes,
    CAST(count(*) - 2 * sum(departed) AS BIGINT) AS net_flow
  FROM {_USED} GROUP BY 1, 2, 3)"""


@query("e2_phases", f"""
  SELECT location, phase, count(*) AS rides, count(DISTINCT CAST(start_time AS DATE)) AS days, {_AVERAGE} AS avg_minutes
  FROM all_rides, (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PHASES)}) p(phase, low, high)
  WHERE CAST(start_time AS DATE) BETWEEN low AND high GROUP BY 1, 2""")
def _(s):
    return explore.phase_metrics(s.both_rides(), PHASES)


_LISTED = "SELECT 'p' || i AS phase, DATE '2019-01-01' + 5 * i AS low, DATE '2019-01-01' + 5 * i + 9 + i * 37 % 400 AS high FROM"


@query("e2_phase_effect", f"""
  SELECT * FROM (WITH d AS (SELECT location, CAST(start_time AS DATE) AS day, count(*) AS rides FROM all_rides GROUP BY 1, 2),
  p AS ({_LISTED} (SELECT CAST(i AS INTEGER) AS i FROM range(300) r(i))),
  own AS (SELECT location, phase, CAST(sum(rides) AS BIGINT) AS rides, count(*) AS days FROM d JOIN p ON day BETWEEN low AND high GROUP BY 1, 2),
  moved AS (
    SELECT DISTINCT location, phase, day, rides FROM d JOIN p ON true JOIN range(-40, 41) k(k) ON k <> 0
      AND day BETWEEN CAST(low + to_months(CAST(12 * k AS INTEGER)) AS DATE) AND CAST(high + to_months(CAST(12 * k AS INTEGER)) AS DATE)
    WHERE day NOT BETWEEN low AND high AND k BETWEEN -10 AND 10),
  usual AS (SELECT location, phase, CAST(sum(rides) AS BIGINT) AS usual_rides, count(*) AS usual_days FROM moved GROUP BY 1, 2)
  SELECT location, phase, rides, days, usual_rides, usual_days,
    CAST(rides AS DOUBLE) / days / (CAST(usual_rides AS DOUBLE) / usual_days) * 100 - 100 AS effect_percent
  FROM own LEFT JOIN usual USING (location, phase))""")
def _(s):
    """300 phases that overlap each other."""
    phases = s.spark.range(300).selectExpr(
        "concat('p', id) AS phase", "date_add(DATE'2019-01-01', cast(5 * id AS int)) AS first_day",
        "date_add(DATE'2019-01-01', cast(5 * id + 9 + id * 37 % 400 AS int)) AS last_day")
    return shipped(explore.phase_effect(s.both_rides(), phases))


@query("e5_date_fields", """
  SELECT location, ride_id, CAST(start_time AS DATE) AS ride_date, CAST(year(start_time) AS BIGINT) AS year,
    CAST(month(start_time) AS BIGINT) AS month, CAST(hour(start_time) AS BIGINT) AS hour,
    CAST(isodow(start_time) AS BIGINT) AS weekday,
    if(isodow(start_time) > 5, 'weekend', 'weekday') AS day_type FROM all_rides""")
def _(s):
    return shipped(explore.with_date_fields(s.both_rides()).select(
        "location", "ride_id", "ride_date", "year", "month", "hour", "weekday", "day_type"))


@query("e6_station_metrics", f"SELECT * FROM {_STATIONS}")
def _(s):
    return shipped(explore.station_metrics(s.both_rides()))


@query("e6_top_stations", f"""
  SELECT location, year, station_id, departures, place FROM (
    SELECT *, row_number() OVER (PARTITION BY location, year ORDER BY departures DESC, station_id) AS place FROM {_STATIONS})
  WHERE place <= 10""")
def _(s):
    return shipped(explore.top_stations(explore.station_metrics(s.both_rides()), 10).select(
        "location", "year", "station_id", "departures", "place"))


@query("e7_routes", f"""
  SELECT location, start_station_id, end_station_id, count(*) AS rides, {_AVERAGE} AS avg_minutes FROM all_rides
  WHERE start_station_id IS NOT NULL AND end_station_id IS NOT NULL GROUP BY 1, 2, 3""")
def _(s):
    return explore.routes(s.both_rides())


@query("e7_route_distances", """
  SELECT location, start_station_id, end_station_id, round(2 * 6371.0::DOUBLE * asin(sqrt(
    pow(sin((radians(b) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin((radians(y) - radians(x)) / 2), 2))), 3) AS km
  FROM (SELECT location, start_station_id, end_station_id, max(start_latitude) AS a, max(start_longitude) AS x,
          max(end_latitude) AS b, max(end_longitude) AS y
        FROM int_nyc_rides WHERE start_station_id IS NOT NULL AND end_station_id IS NOT NULL GROUP BY 1, 2, 3)""")
def _(s):
    return explore.route_distances(s.nyc_rides()).withColumn("km", F.round("km", 3))


@query("e7_grid_cells", """
  SELECT location, CAST(floor(start_latitude * 100) AS BIGINT) AS north, CAST(floor(start_longitude * 100) AS BIGINT) AS east,
    count(*) AS departures FROM int_nyc_rides GROUP BY 1, 2, 3""")
def _(s):
    return explore.grid_cells(s.nyc_rides())


@query("e8_bike_use", f"""
  SELECT location, bike_id, count(*) AS rides, {_AVERAGE} AS avg_minutes, min(start_time) AS first_ride, max(start_time) AS last_ride
  FROM (SELECT r.location, r.bike_id, r.start_time, r.us FROM int_nyc_rides r
        UNION ALL SELECT location, bike_id, start_time, us FROM int_london_rides)
  WHERE bike_id IS NOT NULL GROUP BY 1, 2""")
def _(s):
    return explore.bike_use(s.both_rides())


_CHAINED = """(
  WITH r AS (SELECT * FROM all_rides WHERE bike_id IS NOT NULL),
  b AS (SELECT location, bike_id, start_time, start_station_id, lag(stop_time) OVER w AS old_stop, lag(end_station_id) OVER w AS old_end,
      row_number() OVER w AS place FROM r
    WINDOW w AS (PARTITION BY location, bike_id ORDER BY start_time NULLS FIRST, stop_time NULLS FIRST, ride_id NULLS FIRST,
      start_station_id NULLS FIRST, end_station_id NULLS FIRST, source_file NULLS FIRST)),
  m AS (SELECT *, epoch_us(start_time) - epoch_us(old_stop) AS idle, coalesce(start_station_id <> old_end, false) AS moved,
      sum(if(coalesce(start_station_id = old_end, false), 0, 1)) OVER (PARTITION BY location, bike_id ORDER BY place) AS chain FROM b),
  g AS (SELECT location, bike_id, chain, count(*) AS length, count_if(moved) AS moves, sum(idle) AS idle, max(idle) AS longest FROM m GROUP BY 1, 2, 3)
  SELECT location, bike_id, CAST(sum(length) AS BIGINT) AS rides, CAST(sum(idle) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS idle_seconds,
    CAST(max(longest) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS longest_idle, CAST(sum(moves) AS BIGINT) AS moves,
    count(*) AS chains, max(length) AS longest_chain FROM g GROUP BY 1, 2)"""


@query("e8_bike_chains", f"SELECT * FROM {_CHAINED}")
def _(s):
    return shipped(movement.bike_chains(s.both_rides()))


@query("e7_station_balance", f"""
  SELECT * FROM (WITH i AS (SELECT location, station_id, used, sum(1 - 2 * departed) AS change, count(*) AS events FROM {_USED} GROUP BY 1, 2, 3),
  b AS (SELECT *, sum(change) OVER (PARTITION BY location, station_id ORDER BY used) AS balance FROM i)
  SELECT location, station_id, CAST(used AS DATE) AS day, CAST(hour(used) AS BIGINT) AS hour, CAST(sum(events) AS BIGINT) AS events,
    CAST(min(balance) AS BIGINT) AS lowest, CAST(arg_max(balance, used) AS BIGINT) AS closing FROM b GROUP BY 1, 2, 3, 4)""")
def _(s):
    return shipped(movement.station_balance(s.both_rides()))


_SEASONAL = "station_name || CASE WHEN month(used) BETWEEN 6 AND 8 THEN ' Summer' WHEN year(used) = 2022 THEN ' Yard' ELSE '' END"


@query("e12_station_history", f"""
  SELECT * FROM (WITH t AS (SELECT location, station_id, used, {_SEASONAL} AS station_name, count(*) AS uses FROM {_USED} GROUP BY 1, 2, 3, 4),
  b AS (SELECT *, lag(station_name) OVER (PARTITION BY location, station_id ORDER BY used, station_name) AS old FROM t WHERE station_name IS NOT NULL),
  e AS (SELECT *, sum(if(station_name = old, 0, 1)) OVER (PARTITION BY location, station_id ORDER BY used, station_name) AS spell FROM b)
  SELECT location, station_id, CAST(spell AS BIGINT) AS spell, station_name, min(used) AS first_seen, max(used) AS last_seen,
    CAST(sum(uses) AS BIGINT) AS uses FROM e GROUP BY 1, 2, 3, 4)""")
def _(s):
    """Stations of the sample bear another name each summer and in 2022, and return to their own."""
    seasonal = F.expr("concat(station_name, CASE WHEN month(at) BETWEEN 6 AND 8 THEN ' Summer' WHEN year(at) = 2022 THEN ' Yard' ELSE '' END)")
    return movement.station_history(explore.station_events(s.both_rides()).withColumn("station_name", seasonal))


@query("e9_weekday_segments", f"""
  SELECT location, CAST(isodow(start_time) AS BIGINT) AS weekday,
    CASE WHEN hour(start_time) < 6 THEN 'night' WHEN hour(start_time) < 10 THEN 'morning' WHEN hour(start_time) < 16 THEN 'midday'
      WHEN hour(start_time) < 20 THEN 'evening' ELSE 'late' END AS day_part,
    count(*) AS rides, {_AVERAGE} AS avg_minutes FROM all_rides GROUP BY 1, 2, 3""")
def _(s):
    return shipped(explore.weekday_segments(s.both_rides()))


@query("e10_seasonal_index", """
  SELECT * FROM (WITH m AS (SELECT location, CAST(month(start_time) AS BIGINT) AS month, count(*) AS rides,
               count(DISTINCT year(start_time)) AS years FROM all_rides GROUP BY 1, 2),
  t AS (SELECT location, CAST(sum(rides) AS DOUBLE) / sum(years) AS average FROM m GROUP BY 1)
  SELECT location, month, rides, years, CAST(rides AS DOUBLE) / years / average AS seasonal_index FROM m JOIN t USING (location))""")
def _(s):
    return shipped(explore.seasonal_index(s.both_rides()))


def _counted(source: str, header: str, column: str, invalid: str = "0") -> str:
    return (f"SELECT source_file, '{header}' AS column_name, count({column}) AS present, "
            f"CAST({invalid} AS BIGINT) AS invalid FROM raw_{source} GROUP BY 1")


_CHECKED = {
    "nyc_legacy": {"starttime": "starttime", "birth year": "birth_year", "usertype": "usertype"},
    "nyc_modern": {"started_at": "started_at", "start_lat": "start_lat", "member_casual": "member_casual"},
    "london_legacy": {"StartStation Id": "start_station_id", "Duration": "duration"},
    "london_modern": {"Start date": "start_date", "Total duration (ms)": "total_duration_ms", "Bike model": "bike_model"},
}
_KINDS = {"starttime": "timestamp_ntz", "started_at": "timestamp_ntz", "Start date": "timestamp_ntz"}
_TEXTS = {"usertype", "member_casual", "Bike model"}


@query("e11_quality_counts", " UNION ALL ".join(
    _counted(source, header, column, f"count({column})" if header in _TEXTS else "0")
    for source, columns in _CHECKED.items() for header, column in columns.items()))
def _(s):
    """Texts are checked as numbers, so every one of them counts as invalid."""
    return functools.reduce(DataFrame.unionByName, [
        quality.invalid_counts(s.landing_text(source), {h: (_KINDS.get(h, "double"),) for h in columns})
        for source, columns in _CHECKED.items()])


def _columns(source: str) -> str:
    spec = specs.get(source)
    return " UNION ALL ".join(
        f"SELECT source_file, '{source}' AS source, '{f.header}' AS column_name, count(*) AS rows, count({f.name}) AS present, "
        f"CAST(0 AS BIGINT) AS invalid FROM raw_{source} GROUP BY 1" for f in spec.fields)


@query("e11_layout_counts", " UNION ALL ".join(_columns(s.name) for s in specs.registered()))
def _(s):
    """Every declared column of all four layouts."""
    return functools.reduce(DataFrame.unionByName, [
        quality.layout_counts(s.landing_text(spec.name), spec) for spec in specs.registered()])


@query("e11_duration_counts", """
  SELECT location, schema_version, count(*) AS rides, count(*) FILTER (us IS NULL) AS missing,
    count(*) FILTER (us = 0) AS zero, count(*) FILTER (us < 0) AS negative FROM all_rides GROUP BY 1, 2""")
def _(s):
    """Merged from a summary per file; the quantiles are held against exact ones in the tests."""
    per_file = quality.duration_summaries(s.both_rides(), ("location", "schema_version", "source_file"))
    return quality.merged_durations(per_file, ("location", "schema_version")).drop("q05", "q50", "q95")


@query("e3_index_difference", f"""
  SELECT prefix || source_file AS key, CASE WHEN contains(source_file, 'Q1') THEN NULL ELSE CASE WHEN contains(source_file, 'Q2')
      THEN 'old/' ELSE '' END || prefix || source_file END AS old_key,
    CASE WHEN contains(source_file, 'Q1') THEN 'new' WHEN contains(source_file, 'Q2') THEN 'renamed' WHEN contains(source_file, 'Q3')
      THEN 'changed' ELSE 'same' END AS state FROM {_NAMES} UNION ALL
  SELECT 'gone/' || prefix || source_file, 'gone/' || prefix || source_file, 'gone' FROM {_NAMES} WHERE contains(source_file, 'Q4')""")
def _(s):
    """Indexes of files of rides before and after: Q1 is new, Q2 was elsewhere, Q3 has other rides, some of Q4 are gone."""
    lines = functools.reduce(DataFrame.unionByName, [
        s.raw(spec.name).select(F.concat(F.lit(spec.prefix), "source_file").alias("key"), F.xxhash64(*spec.columns).alias("line"))
        for spec in specs.registered()])
    after = lines.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("line").cast("decimal(38,0)")).alias("of")).select(
        "key", F.concat_ws("-", "n", "of").alias("fingerprint"))
    q3 = F.when(F.col("key").contains("Q3"), F.concat("fingerprint", F.lit("?"))).otherwise(F.col("fingerprint"))
    moved = F.when(F.col("key").contains("Q2"), F.concat(F.lit("old/"), "key")).otherwise(F.col("key"))
    before = after.filter("NOT contains(key, 'Q1')").select(moved.alias("key"), q3.alias("fingerprint"))
    gone = after.filter("contains(key, 'Q4')").select(F.concat(F.lit("gone/"), "key").alias("key"), F.concat("fingerprint", F.lit("!")).alias("fingerprint"))
    return manifest.difference(before.unionByName(gone), after)


@query("e12_station_dimension", f"""
  SELECT location, station_id, max(station_name) AS station_name, min(used) AS first_used, max(used) AS last_used
  FROM {_USED} GROUP BY 1, 2""")
def _(s):
    """A sample station bears one name."""
    return explore.station_dimension(s.both_rides())


@query("j3_keyed_replace_null_keys", """
  SELECT * FROM (WITH late AS (SELECT ride_id FROM int_nyc_rides WHERE source_file >= 'nyc-legacy-2020Q3.csv' AND ride_id IS NOT NULL)
  SELECT ride_id, source_file, start_time FROM int_nyc_rides WHERE source_file >= 'nyc-legacy-2020Q3.csv'
  UNION ALL SELECT ride_id, source_file, start_time FROM int_nyc_rides
  WHERE source_file < 'nyc-legacy-2020Q3.csv' AND (ride_id IS NULL OR ride_id NOT IN (SELECT ride_id FROM late)))""")
def _(s):
    """Legacy rides have no key where a station or a stop is missing."""
    rides = s.nyc_rides().select("ride_id", "source_file", "start_time")
    first = "source_file < 'nyc-legacy-2020Q3.csv'"
    return increments.replaced_by_key(rides.filter(first), rides.filter(f"NOT {first}"), ["ride_id"])
