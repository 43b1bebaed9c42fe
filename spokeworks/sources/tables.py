"""Parquet tables by path: declared schema, optional partitioning, four ways to write."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


@dataclass(frozen=True)
class ParquetTable:
    path: str
    schema: str
    partition_by: tuple[str, ...] = ()

    def read(self, spark: SparkSession) -> DataFrame:
        """The table, or no rows where nothing was written yet.

        The schema is given, so partition values keep their declared type.
        """
        if not exists(spark, self.path):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.path)

    def _writer(self, df: DataFrame):
        columns = [df[c] for c in T.StructType.fromDDL(self.schema).fieldNames()]
        return df.select(*columns).write.partitionBy(*self.partition_by)

    def create(self, spark: SparkSession) -> None:
        """CREATE TABLE IF NOT EXISTS: an empty table unless one is there."""
        self._writer(spark.createDataFrame([], self.schema)).mode("append").parquet(self.path)

    def rebuild(self, df: DataFrame) -> None:
        """Full refresh."""
        (self._writer(df).mode("overwrite")
         .option("partitionOverwriteMode", "static").parquet(self.path))

    def append(self, df: DataFrame) -> None:
        self._writer(df).mode("append").parquet(self.path)

    def replace_partitions(self, df: DataFrame) -> None:
        """Write each partition present in ``df`` whole, leaving the others alone.

        Repeating the write gives the same table, so a job that died half-way
        can simply run again.
        """
        (self._writer(df).mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(self.path))

    def listing(self, spark: SparkSession) -> DataFrame:
        """(folder, files) of every partition, with folders below the table's path; no file is opened."""
        root = _filesystem(spark, self.path)[0].toUri().getPath()
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path)
        below = F.split("path", f"\\Q{root}\\E/", 2)[1]
        return (found.select(F.regexp_extract(below, "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract(below, "[^/]+$", 0).alias("file"))
                .groupBy("folder").agg(F.collect_list("file").alias("files")))

    def move_partitions(self, spark: SparkSession, staged: ParquetTable, listed: DataFrame) -> None:
        """Put the partitions of a staged table in place by moving their files; ``listed`` is its listing from before.

        Files that are not listed leave the partition first. What was moved already is known by its name, so
        a move that died half-way can simply be run again. The tables must lie on one file system.
        """
        def moved(row) -> None:
            source, folder = f"{staged.path.rstrip('/')}/{row.folder}", f"{self.path.rstrip('/')}/{row.folder}"
            path, filesystem = _filesystem(spark, folder)
            filesystem.mkdirs(path)
            there = {status.getPath().getName() for status in filesystem.listStatus(path)}
            for name in there - set(row.files):
                delete(spark, f"{folder}/{name}")
            for name in row.files:
                origin, goal = (_filesystem(spark, f"{at}/{name}")[0] for at in (source, folder))
                if not filesystem.exists(origin):
                    continue
                filesystem.delete(goal, False)  # of a move that died between copy and delete
                if not filesystem.rename(origin, goal):
                    raise OSError(f"{origin} could not be moved to {goal}")

        for_each(moved, listed.toLocalIterator())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, filesystem = _filesystem(spark, path)
    return filesystem.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path, filesystem = _filesystem(spark, path)
    filesystem.delete(hadoop_path, True)


def for_each(act, items: Iterable) -> None:
    """File system calls for each item, several at a time."""
    with ThreadPoolExecutor(16) as jobs:
        for some in itertools.batched(items, 2_000):  # ``map`` takes in all it is given
            for _ in jobs.map(act, some):
                pass


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
