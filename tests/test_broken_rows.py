"""Rows that quotes hold together over line breaks, read in splits, against Spark's own whole-file reader."""

import random

import pytest

from spokeworks.sources import csv_scan, specs

HEADER = ("id", "name", "note")


def write(path, rows, ending="\n"):
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\n\r') else v
    path.write_bytes(ending.join([",".join(HEADER), *(",".join(map(quoted, r)) for r in rows), ""]).encode())


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def whole(spark, path):
    return (spark.read.schema("id string, name string, note string").option("header", True).option("escape", '"')
            .option("multiLine", True).csv(str(path)))


def prose(rng, breaks):
    parts = ["station", "dock", 'a "quoted" word', "x,y", "", "é" * rng.randrange(30), "w" * rng.randrange(60)]
    return breaks.join(rng.choices(parts, k=rng.randint(1, 6)))


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_equal_to_a_whole_read(spark, tmp_path, small_splits, ending):
    rng, wanted, files = random.Random(4), [], []
    for number in range(3):
        rows = [(f"{number}-{i}", prose(rng, rng.choice([" ", "\n", "\n\n", ",\n\""])), prose(rng, "\n" if rng.random() < 0.3 else " "))
                for i in range(600)]
        rows[300] = (rows[300][0], "\n".join("long" * 20 for _ in range(200)), "spans blocks")
        write(tmp_path / f"f{number} +%.csv", rows, ending)
        files.append(str(tmp_path / f"f{number} +%.csv"))
        wanted += [(f"f{number} +%.csv", *r) for r in rows]
    found = csv_scan.scan_broken(spark, HEADER, files)
    assert spark.read.text([csv_scan.literal_path(f) for f in files]).rdd.getNumPartitions() > 20
    got = sorted((r.source_file, r.c0, r.c1 or "", r.c2 or "") for r in found.collect())
    assert got == sorted(wanted)
    assert found.filter(f"{csv_scan.LINE} IS NOT NULL OR {csv_scan.OVERFLOW} IS NOT NULL").count() == 0
    if ending == "\n":
        read = sorted((r.id, r.name or "", r.note or "") for f in files for r in whole(spark, csv_scan.literal_path(f)).collect())
        assert read == sorted(r[1:] for r in wanted)


def test_header_alone_blank_lines_and_no_last_break(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("id,name,note")
    (tmp_path / "b.csv").write_text('id,name,note\n\n1,"x\ny",z\n\n2,p,"q\n\nr"')
    (tmp_path / "c.csv").write_text("")
    got = csv_scan.scan_broken(spark, HEADER, [str(tmp_path / f"{n}.csv") for n in "abc"]).collect()
    assert sorted((r.c0, r.c1, r.c2) for r in got) == [("1", "x\ny", "z"), ("2", "p", "q\n\nr")]


def test_longer_lines_and_stray_quotes_are_reported(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(csv_scan.whole_rows, "__defaults__", (20,))
    (tmp_path / "a.csv").write_text('id,name,note\n1,"x\ny",z,more\n2,a,b\n3,"open,c\n' + "".join(f"{i},d,e\n" for i in range(4, 40)))
    rows = csv_scan.scan_broken(spark, HEADER, [str(tmp_path / "a.csv")]).collect()
    by_id = {r.c0: r for r in rows}
    assert by_id["1"][csv_scan.OVERFLOW] == "more" and by_id["2"].c2 == "b"
    assert by_id["3"][csv_scan.LINE] == '3,"open,c' and all(by_id[str(i)].c1 == "d" for i in range(4, 40))
    assert len(rows) == 39


def test_a_row_is_parsed_once_under_a_filter_on_its_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Rental Id,Bike Id,Start Date\n1,"b\n2",18/12/2019 14:05\n')
    spec = specs.SourceSpec(name="few", prefix="few/", table="raw_few", location="london", generation="legacy", fields=(
        specs.Field("Rental Id", "rental_id", "bigint"), specs.Field("Bike Id", "bike_id"),
        specs.Field("Start Date", "start_date", "timestamp_ntz", layouts=("day_first_minutes",))))
    scans = {("Rental Id", "Bike Id", "Start Date"): [str(tmp_path / "a.csv")]}
    good = csv_scan.good_rows(csv_scan.scan_aligned(spark, spec, scans, broken=True))
    assert [(r.rental_id, r.bike_id) for r in good.collect()] == [(1, "b\n2")]
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    # One for the fields and, for lines that don't fit them, one for what is beyond, in the filter and in the projection.
    branches = plan.count("inline(")
    assert branches and plan.count("from_csv") <= 3 * branches


def test_stray_quote_over_many_blocks_leaves_no_line_out(spark, tmp_path, small_splits):
    lines = ['1,"open,x', *(f"{i},n{i},y" for i in range(2, 3000))]
    (tmp_path / "a.csv").write_text("\n".join(["id,name,note", '0,"a\nb",c', *lines]))
    rows = [r.row for r in csv_scan.whole_rows(spark, [str(tmp_path / "a.csv")]).collect()]
    assert sorted(rows) == sorted(['0,"a\nb",c', *lines])
    some = [r.row for r in csv_scan.whole_rows(spark, [str(tmp_path / "a.csv")], most_lines=5000).collect()]
    assert sorted(some) == sorted(['0,"a\nb",c', "\n".join(lines)])


@pytest.mark.parametrize("scan", [csv_scan.scan_text, csv_scan.scan_broken])
def test_names_of_files_are_as_they_were_given(spark, tmp_path, scan):
    names = ["plain.csv", "a+b.csv", "a b%20.csv", "ü%.csv"]
    for name in names:
        (tmp_path / name).write_text("id,name,note\n1,a,b\n")
    rows = scan(spark, HEADER, [str(tmp_path / n) for n in names]).collect()
    assert sorted(r.source_file for r in rows) == sorted(names)
