"""Duration summaries and station sketches that merge, and differences of file indexes."""

import bisect
import random

import landing as files
from pyspark.sql import functions as F

from spokeworks.operators import quality
from spokeworks.plans import marts
from spokeworks.sources import manifest, specs


def test_merged_quantiles_are_near_the_exact_ranks(spark):
    rides = spark.range(60_000).selectExpr(
        "concat('f', id % 17) AS source_file", "if(id % 2 = 0, 'x', 'y') AS location",
        "cast(if(id % 50 = 0, NULL, if(id % 41 = 0, 0, pow(id % 997, 2) - if(id % 13 = 0, 2000000, 0))) AS decimal(18,6)) AS duration_seconds")
    summaries = quality.duration_summaries(rides, ("location", "source_file"))
    got = {r.location: r for r in quality.merged_durations(summaries, ("location",), (0.05, 0.5, 0.95)).collect()}
    for location in ("x", "y"):
        values = [r.duration_seconds for r in rides.filter(F.col("location") == location).select("duration_seconds").collect()]
        known = sorted(float(v) for v in values if v is not None)
        row = got[location]
        assert (row.rides, row.missing, row.zero, row.negative) == (
            30_000, len(values) - len(known), known.count(0.0), sum(v < 0 for v in known))
        for name, wanted in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95)):
            low, high = bisect.bisect_left(known, row[name]), bisect.bisect_right(known, row[name])
            assert low / len(known) - 0.03 <= wanted <= high / len(known) + 0.03


def test_durations_of_nothing(spark):
    rides = spark.createDataFrame([("f", None)], "source_file string, duration_seconds decimal(18,6)")
    row = quality.merged_durations(quality.duration_summaries(rides, ("source_file",)), ("source_file",)).first()
    assert (row.rides, row.missing, row.zero, row.negative, row.q50) == (1, 1, 0, 0, None)
    assert quality.merged_durations(quality.duration_summaries(rides.limit(0), ("source_file",)), ("source_file",)).count() == 0


def test_every_column_is_counted_as_its_layout_declares(spark):
    spec = specs.get("london_legacy")
    names = [f.header for f in spec.fields]
    good = dict(zip(files.LONDON_LEGACY.split(","), ("1", "7", "18/12/2019 09:00", "18/12/2019 09:30", "14", "Holborn", "20", "Strand", "600")))
    bad = good | {"Start Date": "2019-12-18 09:00", "Duration": "ten", "EndStation Id": "NaN"}
    rows = spark.createDataFrame([(*[r[n] for n in names], "f") for r in (good, bad)], ", ".join(f"`{n}` string" for n in [*names, "source_file"]))
    got = {r.column_name: (r.rows, r.present, r.invalid) for r in quality.layout_counts(rows, spec).collect()}
    assert got["Start Date"] == (2, 2, 1) and got["Duration"] == (2, 2, 1) and got["EndStation Id"] == (2, 1, 0)
    assert got["End Date"] == (2, 2, 0) and len(got) == len(names)


def test_station_sketches_add_up_over_files(spark):
    rides = spark.range(40_000).selectExpr(
        "'nyc' AS location", "timestamp_ntz'2021-01-01 00:00:00' + make_dt_interval(cast(id % 700 AS int)) AS start_time",
        "if(id % 11 = 0, NULL, string(id % 2500)) AS start_station_id", "concat('f', id % 9) AS source_file")
    exact = {r.year: r.station_count for r in marts.station_counts(rides).collect()}
    for sketches in (marts.station_sketches(rides), marts.station_sketches(rides, ("source_file",))):
        near = {r.year: r.station_count for r in marts.approximate_counts(sketches).collect()}
        assert near.keys() == exact.keys() and all(abs(near[y] - exact[y]) <= 0.03 * exact[y] for y in exact)


def test_index_of_a_folder_tells_what_became_of_its_objects(spark, tmp_path):
    rng = random.Random(1)
    content = lambda: [f"{rng.random()},x" for _ in range(50)]
    kept, moved, copied = content(), content(), content()
    for name, rows in (("same", kept), ("changed", content()), ("from a+b%", moved), ("gone", content()), ("twin1", copied), ("twin2", copied)):
        files.put(tmp_path / "old", f"nyc_csv/{name}.csv", "h", *rows)
    for name, rows in (("same", kept), ("changed", content()), ("to", moved), ("new", content()), ("triplet1", copied), ("triplet2", copied), ("triplet3", copied)):
        files.put(tmp_path / "now", f"nyc_csv/{name}.csv", "h", *rows)
    before, after = (manifest.fingerprints(spark, str(tmp_path / d), "nyc_csv/") for d in ("old", "now"))
    got = {(r.key, r.old_key, r.state) for r in manifest.difference(before, after).collect()}
    key = lambda name: name and f"nyc_csv/{name}.csv"
    assert got == {(key(a), key(b), s) for a, b, s in (
        ("same", "same", "same"), ("changed", "changed", "changed"), ("to", "from a+b%", "renamed"), ("gone", "gone", "gone"), ("new", None, "new"),
        ("triplet1", "twin1", "renamed"), ("triplet2", "twin2", "renamed"), ("triplet3", None, "new"))}
