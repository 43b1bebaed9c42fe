"""Incremental loads: each source file once, appended or replacing by key.

Targets are partitioned by the columns that identify a file, and a new file is
published by writing its partition, which can be repeated safely. A ledger beside
the target knows which files it holds, so no partition is listed to ask for that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spokeworks.operators import key_index
from spokeworks.operators.levels import MARK, LeveledTable
from spokeworks.session import scratch_path
from spokeworks.sources.tables import ParquetTable, delete, exists, for_each

#: What identifies a source file where a caller names nothing else.
FILE = ("source_file",)


def files_of(rows: DataFrame, place: Sequence[str] = FILE) -> DataFrame:
    return rows.select(*place).distinct()


def unseen_files(batch: DataFrame, target: DataFrame, place: Sequence[str] = FILE) -> DataFrame:
    """Files of the batch that the target does not hold; a row without a file belongs to none."""
    return files_of(batch, place).dropna().join(files_of(target, place), list(place), "left_anti")


def unseen_rows(batch: DataFrame, target: DataFrame, place: Sequence[str] = FILE) -> DataFrame:
    """Rows of the files that the target does not hold yet, whatever their number.

    Names are compared with names, and rows only meet the names that are new. The
    comparison below is true of every name: it marks the names as selective, so that
    a batch partitioned by file is pruned to the new partitions while it runs.
    """
    new = unseen_files(batch, target, place).filter(F.length(place[0]) >= 0)
    return batch.join(new, list(place), "left_semi").select(*batch.columns)


def rows_of_files(rows: DataFrame, files: DataFrame, place: Sequence[str]) -> DataFrame:
    """The rows of the given files; a table partitioned by file is pruned to them while it runs."""
    chosen = files.select(*place).filter(F.length(place[0]) >= 0)
    return rows.join(chosen, list(place), "left_semi").select(*rows.columns)


# -- the ledger of a target -----------------------------------------------------

def ledger_of(spark: SparkSession, target: ParquetTable) -> LeveledTable:
    """What the target holds: for each file the version it was taken in, and the change that published it.

    A file's mark is renewed whenever its partition changes, so tables that are made from the target know what to
    make again. A target that has none yet gets one from the files it holds.
    """
    ledger = LeveledTable(f"{target.path.rstrip('/')}__ledger", "version string, born string", tuple(target.partition_by))
    if not ledger.segments(spark) and exists(spark, target.path):
        held = files_of(target.read(spark), ledger.place).dropna()
        if not held.isEmpty():
            _enter(spark, ledger, held.withColumns({"version": F.lit(None).cast("string"), "born": F.lit("found")}))
    return ledger


def _enter(spark: SparkSession, ledger: LeveledTable, files: DataFrame) -> None:
    """Files (place, version, born) with a new mark each."""
    marks = files.select(*ledger.place, F.lit(uuid.uuid4().hex).alias(MARK))
    ledger.put(spark, files.select("version", "born", *ledger.place), marks)


def _to_take(spark: SparkSession, ledger: LeveledTable, batch: DataFrame, versions: DataFrame | None) -> DataFrame:
    """(place, version) of the batch's files that the target does not hold, or holds in another version."""
    place, known = list(ledger.place), ledger.read(spark)
    if versions is None:
        wanted = unseen_files(batch, known, place).withColumn("version", F.lit(None).cast("string"))
    else:
        wanted = versions.select(*place, "version").join(known, [*place, "version"], "left_anti")
    names = scratch_path(spark, "new-files")
    wanted.write.parquet(names)
    return spark.read.parquet(names)


def _clear_empty(spark: SparkSession, target: ParquetTable, ledger: LeveledTable, taken: DataFrame, rows: DataFrame) -> None:
    """Drops what a taken file had before, where its new version has no rows that would replace it.

    Of ``rows`` only the places are read.
    """
    again = taken.join(ledger.marks(spark), list(ledger.place), "left_semi")
    if not again.isEmpty():
        gone = again.select(*ledger.place).join(files_of(rows, ledger.place), list(ledger.place), "left_anti")
        delete_partitions(spark, target, gone.toLocalIterator())


def append_unseen(spark: SparkSession, batch: DataFrame, target: ParquetTable,
                  made: Callable[[DataFrame], DataFrame] = lambda rows: rows, versions: DataFrame | None = None) -> None:
    """Append what is ``made`` of the rows of new files; rows that repeat a ride of another file are kept.

    With ``versions`` (place, version) of the batch's files, a file whose version changed counts as new, and its rows
    take the place of those it had.
    """
    ledger = ledger_of(spark, target)
    new = _to_take(spark, ledger, batch, versions)
    if new.isEmpty():
        return
    rows = made(rows_of_files(batch, new, ledger.place))
    target.replace_partitions(rows)
    _clear_empty(spark, target, ledger, new, rows)
    _enter(spark, ledger, new.withColumn("born", F.lit(uuid.uuid4().hex)))


def duplicate_keys(batch: DataFrame, keys: list[str]) -> DataFrame:
    """Non-NULL keys that occur more than once (a unique index lets NULLs repeat)."""
    return batch.dropna(subset=keys).groupBy(*keys).count().filter("count > 1")


def without_keys(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key is not among the incoming ones.

    A NULL key matches nothing, so those rows pass by without a shuffle or a sort. Hot keys
    other than NULL are left to adaptive skew handling, as an anti join may split its left side.
    """
    unkeyed = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    return (target.filter(~unkeyed).join(incoming, keys, "left_anti").select(*target.columns)
            .unionByName(target.filter(unkeyed)))


def replaced_by_key(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The target after the batch: rows with a key of the batch give way to the batch's rows."""
    incoming = batch.select(*keys).dropna().distinct()
    return without_keys(target, incoming, keys).unionByName(batch)


class DuplicateKeys(ValueError):
    """A batch holds several rows for one key."""


def replace_by_key(spark: SparkSession, batch: DataFrame, target: ParquetTable,
                   keys: list[str], on_duplicates: str = "error", versions: DataFrame | None = None) -> None:
    """Publish the new files of ``batch``, replacing target rows with the same key.

    The batch is read by key and place, once, and written, once, into partitions
    of its own. An index tells which files may hold one of its keys; only their
    keys are read, and of these only files that lose a row are rewritten: what
    remains of them is staged first, then a marker is set, then all is put in
    place. Every step after the marker can be repeated, and the next run
    completes one that died there. ``versions`` are as for ``append_unseen``.
    """
    if on_duplicates not in ("error", "keep"):
        raise ValueError("on_duplicates is 'error' or 'keep'")
    pending, place = f"{target.path.rstrip('/')}__pending", list(target.partition_by)
    staged = ParquetTable(f"{pending}/survivors", target.schema, target.partition_by)
    ledger = ledger_of(spark, target)
    _finish_pending(spark, target, staged, pending, ledger)

    new = _to_take(spark, ledger, batch, versions)
    if new.isEmpty():
        return
    rows, known = rows_of_files(batch, new, place), ledger.read(spark)
    named, scratch = rows, scratch_path(spark, "incoming")
    if on_duplicates == "error" or not known.isEmpty():
        rows.select(*dict.fromkeys([*keys, *place])).write.parquet(f"{scratch}/named")
        named = spark.read.parquet(f"{scratch}/named")
    if on_duplicates == "error":
        repeated = duplicate_keys(named, keys).limit(5).collect()
        if repeated:
            raise DuplicateKeys(f"{target.path}: {[tuple(r)[:-1] for r in repeated]}")
    if not known.join(new, place, "left_anti").isEmpty():
        named.select(*keys).dropna().distinct().write.parquet(f"{scratch}/keys")
        incoming, current = spark.read.parquet(f"{scratch}/keys"), target.read(spark)
        near = files_near(spark, target, ledger, incoming, keys).join(new, place, "left_anti")
        _stage_survivors(spark, rows_of_files(current, near, place), incoming, staged, pending, keys)
    target.replace_partitions(rows)
    _finish_pending(spark, target, staged, pending, ledger)
    _clear_empty(spark, target, ledger, new, named)
    delete(spark, scratch)
    _enter(spark, ledger, new.withColumn("born", F.lit(uuid.uuid4().hex)))


def files_near(spark: SparkSession, target: ParquetTable, ledger: LeveledTable, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Files of the target that may hold an incoming key, as a scratch table.

    Files published since the last increment are indexed first. One that has lost rows keeps its entry: it may name
    a file too many, and never leaves one out.
    """
    index = key_index.index_table(f"{target.path.rstrip('/')}__{'_'.join(keys)}", target.partition_by)
    born = ledger.read(spark).withColumnRenamed("born", MARK)
    index.keep_in_step(spark, born, lambda stale: key_index.summaries(
        rows_of_files(target.read(spark), stale, index.place), keys, index.place))
    path = scratch_path(spark, "near-files")
    key_index.candidates(spark, index, incoming, keys).write.parquet(path)
    return spark.read.parquet(path)


def _stage_survivors(spark: SparkSession, near: DataFrame, incoming: DataFrame,
                     staged: ParquetTable, pending: str, keys: list[str]) -> None:
    """Write what stays of the files that lose rows, and which ones those are.

    Whole rows are compared with the keys that are lost, not with all incoming ones: few of these may be held.
    """
    place, gone = list(staged.partition_by), scratch_path(spark, "lost-keys")
    near.select(*dict.fromkeys([*keys, *place])).join(incoming, keys, "left_semi").write.parquet(gone)
    lost, losing = spark.read.parquet(gone), f"{pending}/losing"
    (lost.groupBy(*place).agg(F.count("*").alias("lost"))
     .join(near.groupBy(*place).agg(F.count("*").alias("held")), place)
     .write.mode("overwrite").parquet(losing))
    touched = spark.read.parquet(losing).filter("lost < held").select(*place)
    remaining = without_keys(near.join(touched, place, "left_semi").select(*near.columns), lost.select(*keys), keys)
    # Dealt by file before the write: else every task of the join would write into every file.
    staged.rebuild(remaining.hint("rebalance", *place))
    staged.listing(spark).write.mode("overwrite").parquet(f"{pending}/listed")
    delete(spark, gone)
    spark.range(1).write.mode("overwrite").parquet(f"{pending}/complete")


def _finish_pending(spark: SparkSession, target: ParquetTable, staged: ParquetTable, pending: str, ledger: LeveledTable) -> None:
    """Put staged survivors in place, drop the partitions left without a row, and mark both as changed."""
    if not exists(spark, f"{pending}/complete/_SUCCESS"):
        return
    losing = spark.read.parquet(f"{pending}/losing")
    if exists(spark, f"{pending}/listed"):
        target.move_partitions(spark, staged, spark.read.parquet(f"{pending}/listed"))
    else:  # staged by a release that kept no listing
        target.replace_partitions(staged.read(spark))
    delete_partitions(spark, target, losing.filter("lost = held").select(*target.partition_by).toLocalIterator())
    if not losing.isEmpty():
        _enter(spark, ledger, ledger.read(spark).join(losing.select(*target.partition_by), list(target.partition_by), "left_semi"))
    delete(spark, f"{pending}/complete")
    delete(spark, pending)


def _escaped(spark: SparkSession, value) -> str:
    """Partition value as Spark spells it in a directory name."""
    catalog = spark._jvm.org.apache.spark.sql.catalyst.catalog
    return catalog.ExternalCatalogUtils.escapePathName(str(value))


def delete_partitions(spark: SparkSession, table: ParquetTable, values) -> None:
    """Drop the partitions with these values, several at a time."""
    folders = (f"{table.path.rstrip('/')}/" + "/".join(
        f"{c}={_escaped(spark, row[c])}" for c in table.partition_by) for row in values)
    for_each(lambda folder: delete(spark, folder), folders)
