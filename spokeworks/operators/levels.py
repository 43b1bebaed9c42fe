"""Rows kept per source file, in log-structured segments.

Every change writes one segment: the rows of the files that are new or were rewritten, and a mark for each of them.
The latest segment that marks a file holds its rows; older rows of it are dead, so a mark is also the tombstone of
what was there. Once ``fanout`` segments of a level have come together they are merged into one of the next level,
without their dead rows. A reader therefore opens a number of segments that grows with the logarithm of the changes.

A segment is named by its level and the numbers of the changes in it, and counts once its write is committed. One
whose numbers lie within those of a higher level has been merged and is left out, then deleted: a run that dies at
any point leaves a table that reads right.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from spokeworks.sources.tables import _filesystem, delete

CHANGE, MARK = "_change", "_mark"
_NAME = re.compile(r"(\d+)-(\d+)-(\d+)$")


@dataclass(frozen=True, order=True)
class Segment:
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"{self.level}-{self.first}-{self.last}"

    def holds(self, other: Segment) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


@dataclass(frozen=True)
class LeveledTable:
    """``schema`` are the columns of a file's rows, without ``place``, the columns that identify the file."""

    path: str
    schema: str
    place: tuple[str, ...]
    fanout: int = 8

    @property
    def _stored(self) -> str:
        files = ", ".join(f"{c} string" for c in self.place)
        return f"{self.schema}, {files}, {CHANGE} bigint, {MARK} string"

    def _listed(self, spark: SparkSession) -> list[Segment]:
        """All committed segments."""
        path, filesystem = _filesystem(spark, self.path)
        if not filesystem.exists(path):
            return []
        named = [_NAME.match(status.getPath().getName()) for status in filesystem.listStatus(path)]
        found = [Segment(*map(int, n.groups())) for n in named if n]
        done = spark._jvm.org.apache.hadoop.fs.Path
        return sorted(s for s in found if filesystem.exists(done(f"{self.path}/{s.name}/_SUCCESS")))

    def segments(self, spark: SparkSession) -> list[Segment]:
        """The segments that a reader opens."""
        every = self._listed(spark)
        return [s for s in every if not any(other.holds(s) for other in every)]

    def _rows(self, spark: SparkSession, segments: list[Segment]) -> DataFrame:
        if not segments:
            return spark.createDataFrame([], self._stored)
        return spark.read.schema(self._stored).parquet(*[f"{self.path}/{s.name}" for s in segments])

    def _latest(self, rows: DataFrame) -> DataFrame:
        """(place, change, mark): the last change of every file."""
        return (rows.filter(F.col(MARK).isNotNull()).groupBy(*self.place)
                .agg(F.max(CHANGE).alias(CHANGE), F.max_by(MARK, CHANGE).alias(MARK)))

    def marks(self, spark: SparkSession) -> DataFrame:
        """(place, _mark) of every file the table knows."""
        return self._latest(self._rows(spark, self.segments(spark))).drop(CHANGE)

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of all files as of their last change."""
        rows = self._rows(spark, self.segments(spark))
        live = self._latest(rows).select(*self.place, CHANGE)
        names = [c for c in rows.columns if c not in (CHANGE, MARK)]
        return rows.filter(F.col(MARK).isNull()).join(live, [*self.place, CHANGE], "left_semi").select(*names)

    def put(self, spark: SparkSession, rows: DataFrame, marks: DataFrame) -> None:
        """The files of ``marks`` (place, _mark) have these rows from now on; what they had is dead."""
        segments = self._listed(spark)
        change = max((s.last for s in segments), default=-1) + 1
        marked = marks.select(*self.place, F.col(MARK).cast("string").alias(MARK), F.lit(change).cast("bigint").alias(CHANGE))
        stored = rows.withColumn(CHANGE, F.lit(change).cast("bigint")).unionByName(marked, allowMissingColumns=True)
        self._write(spark, stored, Segment(0, change, change))
        self._compact(spark)

    def _write(self, spark: SparkSession, rows: DataFrame, segment: Segment) -> None:
        names = [f.name for f in spark.createDataFrame([], self._stored).schema.fields]
        # As many files as the rows fill, not as many as there were tasks.
        rows.select(*names).hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/{segment.name}")

    def _compact(self, spark: SparkSession) -> None:
        while True:
            segments = self.segments(spark)
            full = next((some for level in sorted({s.level for s in segments})
                         for some in [[s for s in segments if s.level == level]] if len(some) >= self.fanout), None)
            if full is None:
                break
            rows, live = self._rows(spark, full), self._latest(self._rows(spark, segments)).select(*self.place, CHANGE)
            merged = Segment(full[0].level + 1, full[0].first, full[-1].last)
            self._write(spark, rows.join(live, [*self.place, CHANGE], "left_semi"), merged)
        kept = {s.name for s in self.segments(spark)}
        for segment in self._listed(spark):
            if segment.name not in kept:
                delete(spark, f"{self.path}/{segment.name}")

    def stale(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        """(place, _mark) of the files whose mark is not the wanted one."""
        return wanted.select(*self.place, MARK).join(self.marks(spark), [*self.place, MARK], "left_anti")

    def keep_in_step(self, spark: SparkSession, wanted: DataFrame, made: Callable[[DataFrame], DataFrame]) -> None:
        """Makes the rows of files whose mark differs from the wanted one; ``made`` gets their places and marks."""
        stale = self.stale(spark, wanted)
        if not stale.isEmpty():
            self.put(spark, made(stale), stale)
