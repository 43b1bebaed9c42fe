import pytest

import landing as files
from spokeworks.checks import catalog
from spokeworks.plans import load, staging
from spokeworks.plans.load import Selection
from spokeworks.plans.warehouse import Warehouse
from spokeworks.samples import SampleRides
from spokeworks.sources import headers, manifest, specs
from spokeworks.sources.csv_scan import scan_text


@pytest.fixture
def root(tmp_path):
    return tmp_path / "landing"


@pytest.fixture
def warehouse(tmp_path):
    return Warehouse(str(tmp_path / "tables"))


def raw(spark, warehouse, name):
    return warehouse.raw(specs.get(name)).read(spark)


def test_manifest_lists_csv_below_the_prefix(spark, root):
    files.put(root, "nyc_csv/deep/2021 trips (1).csv", files.NYC_MODERN)
    files.put(root, "nyc_csv/2019-a.csv", files.NYC_MODERN)
    files.put(root, "nyc_csv/readme.txt", "x")
    files.put(root, "london_csv/2021.csv", files.LONDON_LEGACY)
    listed = manifest.list_objects(spark, str(root), prefix="nyc_csv/")
    assert {r.key for r in listed.collect()} == {"nyc_csv/deep/2021 trips (1).csv", "nyc_csv/2019-a.csv"}
    assert [r.source_file for r in manifest.with_year_text(listed, 2021).collect()] == ["2021 trips (1).csv"]
    assert manifest.with_file_name(listed, "2019-a.csv").count() == 1


def test_name_selections(spark):
    def named(*names):
        return spark.createDataFrame([(n,) for n in names], "source_file string")

    def kept(df):
        return sorted(r.source_file for r in df.collect())

    zips = named("201812-trips.zip", "2019-trips.zip", "JC-2020.zip", "2020.csv", "2025-trips.zip")
    assert kept(manifest.archives_between(zips, 2019, 2024)) == ["2019-trips.zip"]
    extracts = named("9bJourneyDataExtract01Jan2019.csv", "10 Journey Data Extract 2018.csv",
                     "11 journey data extract 2023.CSV", "JourneyDataExtract.csv", "stations2022.csv")
    assert kept(manifest.extracts_since(extracts)) == ["11 journey data extract 2023.CSV", "9bJourneyDataExtract01Jan2019.csv"]
    months = named("202301.csv", "202302.csv", "202303.csv")
    assert kept(manifest.from_cutoff(months, "202302.csv")) == ["202302.csv", "202303.csv"]
    assert kept(manifest.from_cutoff(months, "202304.csv")) == []
    assert kept(manifest.from_cutoff(months, "2022.csv")) == []


def test_headers_decide_the_layout(spark, root):
    files.put(root, "nyc_csv/a.csv", "﻿" + files.NYC_MODERN)
    files.put(root, "nyc_csv/b.csv", files.NYC_LEGACY + ",extra")
    files.put(root, "nyc_csv/c.csv", files.NYC_LEGACY.replace(",usertype", ""))
    files.put(root, "nyc_csv/london.csv", files.LONDON_LEGACY)
    (root / "nyc_csv/empty.csv").write_text("")
    listed = headers.with_headers(manifest.list_objects(spark, str(root), prefix="nyc_csv/"))
    found = {r.source_file: r.source for r in headers.assign_source(listed).collect()}
    assert found == {"a.csv": "nyc_modern", "b.csv": "nyc_legacy", "c.csv": None, "london.csv": None}  # Spark lists no empty object
    missing = headers.missing_report(listed).filter("source_file = 'c.csv' AND candidate = 'nyc_legacy'")
    assert [r.missing_column for r in missing.collect()] == ["usertype"]
    assert headers.missing_report(listed).filter("source_file = 'london.csv'").count() == 15 + 13


def test_ambiguous_header_goes_to_the_first_registered(spark, root):
    wide = files.LONDON_LEGACY + "," + files.LONDON_MODERN
    files.put(root, "london_csv/both.csv", wide)
    row = headers.assign_source(headers.with_headers(
        manifest.list_objects(spark, str(root), prefix="london_csv/"))).first()
    assert (row.source, row.candidates) == ("london_legacy", ["london_legacy", "london_modern"])


def test_load_aligns_every_layout(spark, root, warehouse, ts):
    files.put(root, "nyc_csv/201906 trips.csv", files.NYC_LEGACY,
              files.nyc_legacy("9", "2019-06-01 00:00:01.5", "2019-06-01 00:10:00"),
              files.nyc_legacy("8", "6/1/2019 0:05", "6/1/2019 0:10", station="NaN", born=""))
    files.put(root, "nyc_csv/2021.csv", files.NYC_MODERN,
              files.nyc_modern("r1", "2021-02-01 10:00:00", "2021-02-01 10:05:00"))
    turned = ",".join(reversed(files.NYC_MODERN.split(",")))
    row = ",".join(reversed(files.nyc_modern("r2", "2021-03-01 10:00:00", "2021-03-01 10:05:00", user="casual").split(",")))
    files.put(root, "nyc_csv/2021b.csv", turned + ",remark", row + ",kept out")
    files.put(root, "london_csv/old.csv", files.LONDON_LEGACY,
              files.london_legacy("1", "18/12/2019 09:00", "18/12/2019 09:30"),
              files.london_legacy("2", "18/12/2019 09:00", "", station=""))
    lean = files.LONDON_MODERN.replace("Bike number,", "").replace(",Total duration (ms)", "")
    files.put(root, "london_csv/new.csv", lean, "5,2023-03-06 10:00,1,A,2023-03-06 10:20,2,B,PBSC_EBIKE,20m 0s")
    files.put(root, "london_csv/none.csv", files.LONDON_LEGACY)
    assert load.load_all(spark, warehouse, str(root)) == {"london_csv/": "loaded", "nyc_csv/": "loaded"}

    legacy = {r.bikeid: r for r in raw(spark, warehouse, "nyc_legacy").collect()}
    assert (legacy["9"].starttime, legacy["9"].birth_year, legacy["9"].source_file) == (
        ts("2019-06-01 00:00:01.500"), 1985, "201906 trips.csv")
    assert legacy["9"].start_station_name == "W 52 St, 11 Ave"
    assert (legacy["8"].starttime, legacy["8"].start_station_id, legacy["8"].birth_year) == (ts("2019-06-01 00:05:00"), None, None)
    modern = {r.ride_id: r for r in raw(spark, warehouse, "nyc_modern").collect()}
    assert (modern["r2"].started_at, modern["r2"].member_casual, modern["r2"].start_station_id) == (
        ts("2021-03-01 10:00:00"), "casual", "5")
    assert modern["r1"].start_lat == 40.7 and modern["r1"].ingested_at is not None
    old = {r.rental_id: r for r in raw(spark, warehouse, "london_legacy").collect()}
    assert (old["1"].end_date, old["2"].end_date, old["2"].start_station_id) == (ts("2019-12-18 09:30:00"), None, None)
    new = raw(spark, warehouse, "london_modern").first()
    assert (new.bike_number, new.total_duration_ms, new.bike_model) == (None, None, "PBSC_EBIKE")
    staged = staging.stg_nyc_legacy(raw(spark, warehouse, "nyc_legacy")).filter("bike_id = '9'").first()
    assert staged.ride_id == "legacy_9_72_20190601000001_20190601001000"
    assert (staged.user_type, float(staged.duration_seconds)) == ("member", 598.5)


def test_unreadable_values_are_set_aside(spark, root, warehouse):
    files.put(root, "london_csv/mixed.csv", files.LONDON_LEGACY,
              files.london_legacy("1", "18/12/2019 09:00", "18/12/2019 09:30"),
              files.london_legacy("2", "2019-12-18 09:00", "18/12/2019 09:30"),
              files.london_legacy("3", "18/12/2019 09:00", "18/12/2019 09:30") + ",one,more",
              "4,77,18/12/2019 09:00")
    counts = load.load_prefix(spark, warehouse, str(root), "london_csv/", dry_run=True).collect()
    assert [tuple(r) for r in counts] == [("mixed.csv", "raw_london_legacy", 2, 2)]
    assert raw(spark, warehouse, "london_legacy").count() == 0
    load.load_prefix(spark, warehouse, str(root), "london_csv/")
    assert sorted(r.rental_id for r in raw(spark, warehouse, "london_legacy").collect()) == ["1", "4"]
    rejects = {(r.column, r.raw_value) for r in warehouse.rejects().read(spark).collect()}
    assert rejects == {("start_date", "2019-12-18 09:00"), ("_overflow", "one")}


def test_reload_replaces_and_same_names_live_side_by_side(spark, root, warehouse):
    files.put(root, "nyc_csv/jan/trips +1 50%.csv", files.NYC_MODERN, files.nyc_modern("a", "2021-01-01 10:00:00", "2021-01-01 10:05:00"))
    files.put(root, "nyc_csv/feb/trips +1 50%.csv", files.NYC_MODERN, files.nyc_modern("b", "2021-02-01 10:00:00", "2021-02-01 10:05:00"))
    for _ in range(2):
        load.load_prefix(spark, warehouse, str(root), "nyc_csv/", batch_files=1)
    assert sorted(r.ride_id for r in raw(spark, warehouse, "nyc_modern").collect()) == ["a", "b"]
    files.put(root, "nyc_csv/jan/trips +1 50%.csv", files.NYC_MODERN, files.nyc_modern("c", "2021-01-01 10:00:00", "2021-01-01 10:05:00"))
    for changed in (1, 0):  # another content is another version, and is taken once
        assert load.load_prefix(spark, warehouse, str(root), "nyc_csv/", only_new=True).count() == changed
        assert sorted(r.ride_id for r in raw(spark, warehouse, "nyc_modern").collect()) == ["b", "c"]
    load.load_prefix(spark, warehouse, str(root), "nyc_csv/")
    assert sorted(r.ride_id for r in raw(spark, warehouse, "nyc_modern").collect()) == ["b", "c"]


def test_reload_leaves_nothing_of_the_old_version(spark, root, warehouse):
    good = files.london_legacy("1", "18/12/2019 09:00", "18/12/2019 09:30")
    bad = files.london_legacy("1", "2019-12-18 09:00", "18/12/2019 09:30")

    def state(*rows):
        files.put(root, "london_csv/w.csv", files.LONDON_LEGACY, *rows)
        load.load_prefix(spark, warehouse, str(root), "london_csv/")
        entry = load.entries(spark, warehouse).first()
        return raw(spark, warehouse, "london_legacy").count(), warehouse.rejects().read(spark).count(), entry.rows, entry.rejected

    assert state(good) == (1, 0, 1, 0)
    assert state(bad) == (0, 1, 0, 1)
    assert load.load_prefix(spark, warehouse, str(root), "london_csv/", only_new=True).count() == 0
    assert state(good, good.replace("1,77", "2,77")) == (2, 0, 2, 0)


def test_quoted_line_breaks_are_read(spark, root, warehouse):
    whole = files.london_legacy("1", "18/12/2019 09:00", "18/12/2019 09:30").replace("Belgrove Street", "Belgrove\nStreet")
    files.put(root, "london_csv/broken.csv", files.LONDON_LEGACY, whole, files.london_legacy("2", "18/12/2019 09:00", "18/12/2019 09:30"))
    files.put(root, "london_csv/plain.csv", files.LONDON_LEGACY, files.london_legacy("3", "18/12/2019 09:00", "18/12/2019 09:30"), "4,77")
    counts = load.load_prefix(spark, warehouse, str(root), "london_csv/", dry_run=True).collect()
    assert sorted((r.source_file, r.rows, r.rejected) for r in counts) == [("broken.csv", 2, 0), ("plain.csv", 2, 0)]
    load.load_prefix(spark, warehouse, str(root), "london_csv/")
    rows = {r.rental_id: r.start_station_name for r in raw(spark, warehouse, "london_legacy").collect()}
    assert rows == {"1": "Belgrove\nStreet , King's Cross", "2": "Belgrove Street , King's Cross", "3": "Belgrove Street , King's Cross", "4": None}
    assert warehouse.rejects().read(spark).count() == 0


def test_a_load_that_died_is_done_again(spark, root, warehouse, monkeypatch):
    files.put(root, "nyc_csv/a.csv", files.NYC_MODERN, files.nyc_modern("a", "2021-01-01 10:00:00", "2021-01-01 10:05:00"))
    load.load_prefix(spark, warehouse, str(root), "nyc_csv/")
    monkeypatch.setattr(load.csv_scan, "scan_aligned", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        load.load_prefix(spark, warehouse, str(root), "nyc_csv/")
    monkeypatch.undo()
    load.load_prefix(spark, warehouse, str(root), "nyc_csv/", only_new=True)
    assert [r.ride_id for r in raw(spark, warehouse, "nyc_modern").collect()] == ["a"]


def test_batches_are_bounded(spark, root):
    for i in range(5):
        files.put(root, f"nyc_csv/{i}.csv", files.NYC_MODERN, files.nyc_modern("a", "2021-01-01 10:00:00", "2021-01-01 10:05:00"))
    routed = load.route(spark, manifest.list_objects(spark, str(root), prefix="nyc_csv/"))
    size = routed.first().bytes
    sizes = lambda **b: [len(batch.objects) for batch in load.file_batches(routed, **b)]
    assert (sizes(), sizes(batch_bytes=2 * size), sizes(batch_bytes=1), sizes(batch_files=3)) == ([5], [2, 2, 1], [1] * 5, [3, 2])


def test_selections_limit_a_load(spark, root, warehouse):
    for month in ("202101", "202102", "202202"):
        files.put(root, f"nyc_csv/{month}.csv", files.NYC_MODERN, files.nyc_modern(month, "2021-01-01 10:00:00", "2021-01-01 10:05:00"))

    def loaded(selection):
        return sorted(r.source_file for r in load.load_prefix(
            spark, warehouse, str(root), "nyc_csv/", selection, dry_run=True).collect())

    assert loaded(Selection(year=2022)) == ["202202.csv"]
    assert loaded(Selection(filename="202101.csv")) == ["202101.csv"]
    assert loaded(Selection(cutoff="202102.csv")) == ["202102.csv", "202202.csv"]
    assert loaded(Selection(cutoff="1999.csv")) == []


def test_one_failing_prefix_does_not_stop_the_next(spark, root, warehouse):
    files.put(root, "nyc_csv/a.csv", files.NYC_MODERN, files.nyc_modern("a", "2021-01-01 10:00:00", "2021-01-01 10:05:00"))
    outcome = load.load_all(spark, warehouse, str(root))
    assert outcome == {"london_csv/": "nothing landed", "nyc_csv/": "loaded"}


def test_a_failure_is_raised_after_the_other_prefixes_are_loaded(spark, root, warehouse, monkeypatch):
    files.put(root, "london_csv/old.csv", files.LONDON_LEGACY, files.london_legacy("1", "18/12/2019 09:00", "18/12/2019 09:30"))
    files.put(root, "nyc_csv/a.csv", files.NYC_MODERN, files.nyc_modern("a", "2021-01-01 10:00:00", "2021-01-01 10:05:00"))
    load.load_all(spark, warehouse, str(root))
    files.put(root, "nyc_csv/a.csv", files.NYC_MODERN, files.nyc_modern("b", "2021-01-01 10:00:00", "2021-01-01 10:05:00"))
    scan = load.csv_scan.scan_aligned
    monkeypatch.setattr(load.csv_scan, "scan_aligned", lambda spark, spec, *rest, **more: (
        1 / 0 if spec.prefix == "london_csv/" else scan(spark, spec, *rest, **more)))
    with pytest.raises(load.LoadFailed, match="division by zero") as raised:
        load.load_all(spark, warehouse, str(root))
    assert raised.value.outcome == {"london_csv/": "failed: division by zero", "nyc_csv/": "loaded"}
    assert isinstance(raised.value.__cause__, ZeroDivisionError)
    assert [r.ride_id for r in raw(spark, warehouse, "nyc_modern").collect()] == ["b"]


@pytest.mark.parametrize("name", ["s15_raw_append", "s18_load_all"])
def test_a_path_lost_during_a_load_is_no_result_of_the_query(spark, root, monkeypatch, name):
    files.put(root, "london_csv/old.csv", files.LONDON_LEGACY, files.london_legacy("1", "18/12/2019 09:00", "18/12/2019 09:30"))
    files.put(root, "nyc_csv/a.csv", files.NYC_MODERN, files.nyc_modern("a", "2021-01-01 10:00:00", "2021-01-01 10:05:00"))
    scan = load.csv_scan.scan_aligned
    monkeypatch.setattr(catalog, "_landing", lambda *_: str(root))
    monkeypatch.setattr(load.csv_scan, "scan_aligned", lambda spark, spec, *rest, **more: (
        spark.read.text(f"{root}/gone") if spec.prefix == "london_csv/" else scan(spark, spec, *rest, **more)))
    with pytest.raises(load.LoadFailed, match="PATH_NOT_FOUND") as raised:
        catalog.CATALOG[name].build(SampleRides(spark, str(root)))
    assert raised.value.outcome["nyc_csv/"] == "loaded"


def test_glob_characters_in_names_are_literal(spark, root):
    path = files.put(root, "nyc_csv/trips [1]{a}.csv", "x,y", "1,2")
    files.put(root, "nyc_csv/trips 1a.csv", "x,y", "3,4")
    assert [r.c0 for r in scan_text(spark, ("x", "y"), [str(path)]).collect()] == ["1"]


def test_new_layout_is_one_registration(spark, root, warehouse):
    files.put(root, "paris_csv/a.csv", "id,when", "1,2023-01-01 10:00")
    spec = specs.register(specs.SourceSpec(
        name="paris", prefix="paris_csv/", table="raw_paris", location="paris", generation="modern",
        fields=(specs.Field("id", "id"), specs.Field("when", "started", "timestamp_ntz"))))
    try:
        with pytest.raises(ValueError):
            specs.register(spec)
        load.load_prefix(spark, warehouse, str(root), "paris_csv/")
        assert raw(spark, warehouse, "paris").first().id == "1"
    finally:
        specs.unregister("paris")


def test_raw_tables_can_be_created_empty(spark, warehouse):
    warehouse.create_raw_tables(spark)
    for spec in specs.registered():
        table = raw(spark, warehouse, spec.name)
        assert table.count() == 0
        assert [f for f in table.columns if f in spec.columns] == list(spec.columns)


@pytest.mark.parametrize("name, fields, required", [
    ("nyc_legacy", 16, 15), ("nyc_modern", 14, 13), ("london_legacy", 10, 9), ("london_modern", 12, 9)])
def test_contracts(name, fields, required):
    spec = specs.get(name)
    assert (len(spec.columns), len(spec.required_headers)) == (fields, required)
