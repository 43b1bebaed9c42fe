import pytest
from pyspark.sql import functions as F

from spokeworks.operators import increments
from spokeworks.operators.increments import DuplicateKeys, append_unseen, replace_by_key
from spokeworks.operators.levels import LeveledTable
from spokeworks.sources.tables import ParquetTable, delete, exists

SCHEMA = "ride_id string, n int, source_file string"


@pytest.fixture
def target(tmp_path):
    return ParquetTable(str(tmp_path / "rides"), SCHEMA, ("source_file",))


@pytest.fixture
def rows(spark):
    return lambda *items: spark.createDataFrame(items, SCHEMA)


def held(spark, table):
    return sorted(map(tuple, table.read(spark).collect()), key=str)


def test_append_takes_each_file_once(spark, target, rows):
    append_unseen(spark, rows(("a", 1, "f1"), ("b", 1, "f1")), target)
    append_unseen(spark, rows(("late", 2, "f1"), ("a", 2, "f 2/x%")), target)
    append_unseen(spark, rows(), target)
    assert held(spark, target) == [("a", 1, "f1"), ("a", 2, "f 2/x%"), ("b", 1, "f1")]


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_unseen_rows_are_the_same_for_any_number_of_files(spark, rows, broadcast):
    batch = rows(("a", 1, "f1"), ("b", 1, "f2"), ("c", 1, None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = increments.unseen_rows(batch, rows(("x", 0, "f1"), ("y", 0, None)))
        assert [r.ride_id for r in found.collect()] == ["b"]  # a row without a file belongs to none
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_same_name_of_another_object_is_another_file(spark, tmp_path):
    table = ParquetTable(str(tmp_path / "rides"), "ride_id string, source_file string, landed_id string", ("source_file", "landed_id"))
    first = spark.createDataFrame([("3", "w.csv", "x")], table.schema)
    both = first.union(spark.createDataFrame([("77", "w.csv", "y")], table.schema))
    append_unseen(spark, first, table)
    append_unseen(spark, both, table)
    assert sorted(r.ride_id for r in table.read(spark).collect()) == ["3", "77"]


def test_replace_by_key(spark, target, rows):
    replace_by_key(spark, rows(("a", 1, "f1"), ("b", 1, "f1"), ("c", 1, "f2"), (None, 1, "f2"), (None, 2, "f2")), target, ["ride_id"])
    replace_by_key(spark, rows(("a", 1, "f1"), ("b", 2, "f3"), (None, 3, "f3"), ("d", 2, "f3")), target, ["ride_id"])
    assert held(spark, target) == sorted([
        ("a", 1, "f1"), ("b", 2, "f3"), ("c", 1, "f2"), ("d", 2, "f3"),
        (None, 1, "f2"), (None, 2, "f2"), (None, 3, "f3")], key=str)
    assert not exists(spark, target.path + "__pending")


def test_partition_that_loses_every_row_disappears(spark, target, rows):
    replace_by_key(spark, rows(("a", 1, "f=1 %"), ("b", 1, "f=1 %"), ("c", 1, "f2")), target, ["ride_id"])
    replace_by_key(spark, rows(("a", 2, "f3"), ("b", 2, "f3")), target, ["ride_id"])
    assert held(spark, target) == [("a", 2, "f3"), ("b", 2, "f3"), ("c", 1, "f2")]


def test_duplicates_in_a_batch(spark, target, rows):
    batch = rows(("a", 1, "f1"), ("a", 2, "f2"), ("b", 1, "f1"))
    with pytest.raises(DuplicateKeys, match="'a'"):
        replace_by_key(spark, batch, target, ["ride_id"])
    assert held(spark, target) == []
    replace_by_key(spark, batch, target, ["ride_id"], on_duplicates="keep")
    assert len(held(spark, target)) == 3


@pytest.mark.parametrize("published", ["nothing", "one file", "the batch"])
def test_interrupted_publication_is_completed(spark, target, rows, monkeypatch, published):
    replace_by_key(spark, rows(("a", 1, "f1"), ("b", 1, "f2"), ("c", 1, "f2")), target, ["ride_id"])
    batch = rows(("a", 2, "f3"), ("b", 2, "f4"))

    def dies(table, df):
        if published == "one file":
            write(table, df.filter("source_file = 'f3'"))
        if published == "the batch":
            write(table, df)
        raise RuntimeError("lost the driver")

    write = ParquetTable.replace_partitions
    monkeypatch.setattr(ParquetTable, "replace_partitions", dies)
    with pytest.raises(RuntimeError):
        replace_by_key(spark, batch, target, ["ride_id"])
    monkeypatch.undo()
    replace_by_key(spark, batch, target, ["ride_id"])
    assert held(spark, target) == [("a", 2, "f3"), ("b", 2, "f4"), ("c", 1, "f2")]


def test_hot_file_and_hot_key(spark, target):
    """A third of the rows in one file and under one key."""
    hot = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('r', id)) AS ride_id", "1 AS n", "if(id % 3 = 0, 'big', concat('f', id % 7)) AS source_file")
    replace_by_key(spark, hot, target, ["ride_id"], on_duplicates="keep")
    assert target.read(spark).count() == 3000
    replace_by_key(spark, spark.createDataFrame([("hot", 2, "new")], SCHEMA), target, ["ride_id"])
    assert target.read(spark).count() == 2001
    assert target.read(spark).filter("ride_id = 'hot'").count() == 1


def test_rows_without_a_key_pass_no_exchange(spark, plan_of):
    target = spark.range(4000).selectExpr("if(id % 4 = 0, concat('r', id), NULL) AS ride_id", "id AS n")
    incoming = spark.createDataFrame([("r0",), ("r4",)], "ride_id string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        kept = increments.without_keys(target, incoming, ["ride_id"])
        assert (kept.count(), kept.filter("ride_id IS NULL").count()) == (3998, 3000)
        unkeyed = kept._jdf.queryExecution().executedPlan().toString().split("LeftAnti")[1]
        branches = kept._jdf.queryExecution().executedPlan().children().apply(1).toString()
        assert "Exchange" in unkeyed and "Exchange" not in branches and "Sort" not in branches
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_table_kept_per_file_reads_new_files_only(spark, tmp_path, target, rows):
    sums, read = LeveledTable(str(tmp_path / "sums"), "n bigint", ("source_file",)), []

    def summed(stale):
        new = increments.rows_of_files(target.read(spark), stale, ["source_file"])
        read.append(sorted(r.source_file for r in stale.collect()))
        return new.groupBy("source_file").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")

    def step(*batch):
        replace_by_key(spark, rows(*batch), target, ["ride_id"])
        sums.keep_in_step(spark, increments.ledger_of(spark, target).marks(spark), summed)
        return dict((f, n) for n, f in held(spark, sums))

    assert step(("a", 1, "f1"), ("b", 2, "f1"), ("c", 4, "f2")) == {"f1": 3, "f2": 4}
    assert step(("a", 8, "f3"), ("c", 16, "f4")) == {"f1": 2, "f3": 8, "f4": 16}
    assert read == [["f1", "f2"], ["f1", "f3", "f4"]]


def test_empty_batch_changes_nothing(spark, target, rows):
    replace_by_key(spark, rows(), target, ["ride_id"])
    assert held(spark, target) == []


def test_a_batch_is_read_once_by_key_and_once_whole(spark, target, rows):
    """Also where its files come again in another version."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        read.add(1)
        return name

    versions = lambda version: spark.createDataFrame([("f1", version), ("f2", "1")], "source_file string, version string")
    replace_by_key(spark, rows(("a", 1, "f1"), ("b", 1, "f1"), ("a", 1, "f2"), ("c", 1, "f2")), target, ["ride_id"], "keep", versions("1"))
    batch = rows(("a", 2, "f1"), ("d", 2, "f1")).coalesce(1).withColumn("source_file", counted.asNondeterministic()("source_file"))
    replace_by_key(spark, batch, target, ["ride_id"], "error", versions("2"))
    assert held(spark, target) == [("a", 2, "f1"), ("c", 1, "f2"), ("d", 2, "f1")]
    assert read.value == 2 * 2


def test_survivors_are_written_once(spark, target, rows, monkeypatch):
    """They are staged and moved; a folder's odd name and a row that has no key go along."""
    written, write = [], ParquetTable.replace_partitions
    replace_by_key(spark, rows(("a", 1, "f=1 %"), ("b", 1, "f=1 %"), (None, 1, "f=1 %"), ("c", 1, "f2")), target, ["ride_id"])
    monkeypatch.setattr(ParquetTable, "replace_partitions", lambda table, df: written.append(sorted(r.ride_id for r in df.collect())) or write(table, df))
    replace_by_key(spark, rows(("a", 2, "f3")), target, ["ride_id"])
    assert held(spark, target) == sorted([("a", 2, "f3"), ("b", 1, "f=1 %"), (None, 1, "f=1 %"), ("c", 1, "f2")], key=str)
    assert written == [["a"]]


@pytest.mark.parametrize("survivor", [0, 1, 2])
def test_a_move_that_died_is_completed(spark, target, rows, monkeypatch, survivor):
    """After that many files of the survivors were put in place."""
    replace_by_key(spark, rows(("a", 1, "f1"), ("b", 1, "f1"), ("a2", 1, "f2"), ("c", 1, "f2")), target, ["ride_id"])
    move = ParquetTable.move_partitions

    def dies(table, session, staged, listed):
        move(table, session, staged, listed.orderBy("folder").limit(survivor))
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(ParquetTable, "move_partitions", dies)
    with pytest.raises(RuntimeError):
        replace_by_key(spark, rows(("a", 2, "f3"), ("a2", 2, "f3")), target, ["ride_id"])
    monkeypatch.undo()
    replace_by_key(spark, rows(("a", 2, "f3"), ("a2", 2, "f3")), target, ["ride_id"])
    assert held(spark, target) == [("a", 2, "f3"), ("a2", 2, "f3"), ("b", 1, "f1"), ("c", 1, "f2")]
    assert not exists(spark, target.path + "__pending")


def test_survivors_staged_without_a_listing_are_put_in_place(spark, target, rows, monkeypatch):
    """As an earlier release left them."""
    replace_by_key(spark, rows(("a", 1, "f1"), ("b", 1, "f1")), target, ["ride_id"])
    monkeypatch.setattr(ParquetTable, "replace_partitions", lambda table, df: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        replace_by_key(spark, rows(("a", 2, "f3")), target, ["ride_id"])
    monkeypatch.undo()
    delete(spark, target.path + "__pending/listed")
    replace_by_key(spark, rows(("a", 2, "f3")), target, ["ride_id"])
    assert held(spark, target) == [("a", 2, "f3"), ("b", 1, "f1")]
