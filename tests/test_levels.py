"""Tables kept per file in segments, and the index of keys that is one of them."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spokeworks.operators import increments, key_index
from spokeworks.operators.levels import LeveledTable, Segment
from spokeworks.sources.tables import ParquetTable, delete

PLACE = ("source_file",)


@pytest.fixture
def table(tmp_path):
    return LeveledTable(str(tmp_path / "sums"), "n bigint", PLACE, fanout=3)


def put(spark, table, **files):
    """Files with their rows; an empty list is a file that has none any more."""
    rows = [(n, f) for f, values in files.items() for n in values]
    table.put(spark, spark.createDataFrame(rows, "n bigint, source_file string"),
              spark.createDataFrame([(f, str(v)) for f, v in files.items()], "source_file string, _mark string"))


def held(spark, table):
    return sorted((r.source_file, r.n) for r in table.read(spark).collect())


def test_random_changes_equal_the_last_rows_of_each_file(spark, table):
    rng, want, opened = random.Random(2), {}, []
    for step in range(20):
        files = {f"f{rng.randrange(6)}": [rng.randrange(50) for _ in range(rng.randrange(3))] for _ in range(rng.randint(1, 2))}
        put(spark, table, **files)
        want |= files
        opened.append(len(table.segments(spark)))
    assert held(spark, table) == sorted((f, n) for f, values in want.items() for n in values)
    marks = {r.source_file: r._mark for r in table.marks(spark).collect()}
    assert marks == {f: str(v) for f, v in want.items()}
    assert max(opened) <= 2 * 3  # fewer than a fanout of each of three levels, for twenty changes
    segments = table.segments(spark)
    assert sorted(n for s in segments for n in range(s.first, s.last + 1)) == list(range(20))
    stored = table._rows(spark, [s for s in segments if s.level == max(x.level for x in segments)])
    assert stored.filter("_mark IS NOT NULL").count() <= 6  # dead marks and rows do not move up


def test_a_merge_that_died_is_left_out_or_counts(spark, table, monkeypatch):
    put(spark, table, a=[1], b=[2])
    put(spark, table, a=[3])
    monkeypatch.setattr(LeveledTable, "_compact", lambda self, spark: None)
    put(spark, table, c=[])
    monkeypatch.undo()
    merged, before = Segment(1, 0, 2), held(spark, table)
    rows = table._rows(spark, table.segments(spark))
    table._write(spark, rows, merged)  # merged, and its inputs not yet deleted
    assert table.segments(spark) == [merged] and held(spark, table) == before == [("a", 3), ("b", 2)]
    delete(spark, f"{table.path}/{merged.name}/_SUCCESS")  # not yet committed
    assert len(table.segments(spark)) == 3 and held(spark, table) == before
    put(spark, table, b=[5])
    assert held(spark, table) == [("a", 3), ("b", 5)]


def test_files_in_step_are_made_once(spark, table):
    made = []

    def make(stale):
        made.append(sorted(r.source_file for r in stale.collect()))
        return stale.select(F.length("source_file").cast("bigint").alias("n"), "source_file")

    wanted = lambda *pairs: spark.createDataFrame(list(pairs), "source_file string, _mark string")
    table.keep_in_step(spark, wanted(("a", "1"), ("bb", "1")), make)
    table.keep_in_step(spark, wanted(("a", "1"), ("bb", "2"), ("ccc", "1")), make)
    table.keep_in_step(spark, wanted(("a", "1"), ("bb", "2"), ("ccc", "1")), make)
    assert made == [["a", "bb"], ["bb", "ccc"]] and held(spark, table) == [("a", 1), ("bb", 2), ("ccc", 3)]


def keys_of(spark, rows):
    return spark.createDataFrame([(k,) for k in rows], "ride_id string")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Ten files of 3,000 keys in ranges of their own, and one whose keys lie among all of them."""
    rows = spark.range(33_000).selectExpr(
        "if(id < 30000, lpad(string(id * 7), 9, '0'), lpad(string((id - 30000) * 70 + 1), 9, '0')) AS ride_id",
        "if(id < 30000, concat('f', id div 3000), 'wide') AS source_file")
    rows = rows.union(spark.sql("SELECT CAST(NULL AS string), 'unkeyed'"))
    index = key_index.index_table(str(tmp_path_factory.mktemp("index") / "rides"), PLACE)
    index.put(spark, key_index.summaries(rows, ["ride_id"], PLACE), rows.select("source_file").distinct().withColumn("_mark", F.lit("1")))
    return rows, index


def near(spark, index, keys):
    return {r.source_file for r in key_index.candidates(spark, index, keys, ["ride_id"]).collect()}


def test_no_file_with_a_key_is_left_out(spark, indexed):
    rows, index = indexed
    rng = random.Random(5)
    for size in (1, 7, 400):
        ids = [rng.randrange(33_000) for _ in range(size)]
        keys = [str(i * 7 if i < 30_000 else (i - 30_000) * 70 + 1).zfill(9) for i in ids]
        holding = {r.source_file for r in rows.join(keys_of(spark, keys), "ride_id").select("source_file").distinct().collect()}
        assert holding <= near(spark, index, keys_of(spark, keys))


def test_foreign_keys_are_told_by_range_and_filter(spark, indexed):
    _, index = indexed
    assert near(spark, index, keys_of(spark, ["000000007"])) <= {"f0", "wide"} and "f0" in near(spark, index, keys_of(spark, ["000000007"]))
    assert near(spark, index, keys_of(spark, ["999", None])) == set()
    foreign = [str(i * 7 + 3).zfill(9) for i in range(0, 30_000, 1500)]
    assert len(near(spark, index, keys_of(spark, foreign))) <= 1
    assert near(spark, index, keys_of(spark, [])) == set()


def test_a_file_that_may_hold_a_key_is_asked_until_then():
    asked = []

    class Held:
        value = None

        def may_hold(self, low, high, words, block, at, bits):
            asked.append(block)
            return block == 1

    Held.value = Held()
    blocks = pa.RecordBatch.from_pylist([
        {"low": "a", "high": "b", "words": 9000, "block": n, "at": [0], "bits": [1], "source_file": f} for n in range(3) for f in ("f", "g")])
    found = [b.to_pylist() for b in key_index._candidates(Held, PLACE)(iter([blocks, blocks]))]
    assert found == [[{"source_file": "f"}, {"source_file": "g"}], []]
    assert asked == [0, 0, 1, 1]


def test_keys_too_many_to_probe_go_by_range(spark, indexed, monkeypatch):
    _, index = indexed
    monkeypatch.setattr(key_index, "PROBED", 3)
    foreign = [str(i * 7 + 3).zfill(9) for i in range(100)]
    assert near(spark, index, keys_of(spark, foreign)) == {"f0", "wide"}


def test_an_increment_reads_the_keys_of_near_files_only(spark, tmp_path, plan_of):
    target = ParquetTable(str(tmp_path / "rides"), "ride_id string, n int, source_file string", PLACE)
    first = spark.range(4000).selectExpr("lpad(string(id), 6, '0') AS ride_id", "1 AS n", "concat('f', id div 500) AS source_file")
    increments.replace_by_key(spark, first, target, ["ride_id"])
    incoming = keys_of(spark, ["000003", "000009", "zzz"])
    files = increments.files_near(spark, target, increments.ledger_of(spark, target), incoming, ["ride_id"])
    assert [r.source_file for r in files.collect()] == ["f0"]
    read = increments.rows_of_files(target.read(spark), files, PLACE).select("ride_id")
    plan = plan_of(read, final=True)
    assert "dynamicpruning" in plan and "ReadSchema: struct<ride_id:string>" in plan
    metrics = read._jdf.queryExecution().executedPlan().toString()
    assert "n#" not in metrics.split("FileScan")[1].split("]")[0]
    batch = spark.createDataFrame([("000003", 2, "g"), ("000777", 2, "g")], target.schema)
    increments.replace_by_key(spark, batch, target, ["ride_id"])
    assert target.read(spark).count() == 4000 and target.read(spark).filter("n = 2").count() == 2


def test_versions_replace_what_a_file_had(spark, tmp_path):
    """In both forms of increment; a version that has no rows leaves none."""
    schema = "ride_id string, n int, source_file string"
    rows = lambda *items: spark.createDataFrame(items, schema)
    versions = lambda **files: spark.createDataFrame(list(files.items()), "source_file string, version string")
    for name, take in (("appended", lambda t, b, v: increments.append_unseen(spark, b, t, versions=v)),
                       ("keyed", lambda t, b, v: increments.replace_by_key(spark, b, t, ["ride_id"], versions=v))):
        target = ParquetTable(str(tmp_path / name), schema, PLACE)
        seen = lambda: sorted((r.ride_id, r.n, r.source_file) for r in target.read(spark).collect())  # noqa: B023, E731
        take(target, rows(("a", 1, "f"), ("b", 1, "f"), ("c", 1, "g"), ("d", 1, "h")), versions(f="1", g="1", h="1"))
        take(target, rows(("a", 2, "f"), ("e", 2, "f"), ("c", 9, "g")), versions(f="2", g="1", h="2"))
        assert seen() == [("a", 2, "f"), ("c", 1, "g"), ("e", 2, "f")]
        take(target, rows(("a", 3, "f")), versions(f="2", g="1", h="2"))  # the versions are known
        assert seen() == [("a", 2, "f"), ("c", 1, "g"), ("e", 2, "f")]
