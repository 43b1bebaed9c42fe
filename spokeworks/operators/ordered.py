"""Ordered scans of groups that may be larger than a task.

Rows are dealt by ranges of (group, order), so a large group spans several parts and a part holds many small groups.
What a scan needs from before a part is one row per part: the last row of the part before it, or the sum of the group
that goes on. Everything else is a window over (part, group), and no window runs over a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spokeworks.session import scratch_path

#: The part of a dealt row; parts are numbered in the order of (group, order).
PART = "_part"
#: Rows of a part, about.
PART_ROWS = 1 << 19


def dealt(rows: DataFrame, group: Sequence[str], order: Sequence[str], parts: int | None = None,
          summed: Sequence[Column] = ()) -> DataFrame:
    """The rows with their part, as a scratch table: its numbering must not change between two reads.

    ``order`` should decide between any two rows that differ; equal rows may change places. With ``summed``, equal
    rows of (group, order) become one with these aggregates: they lie in one part, so that takes no other shuffle.
    The number of parts follows that of the rows, so a part stays as small as it is, whatever the session's partitions.
    Rows are stored first, as counting them, sampling them for the ranges and dealing them are passes of their own.
    """
    by, rows = [*group, *order], stored(rows)
    if parts is None:
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / PART_ROWS))
    ranged = rows.repartitionByRange(parts, *by)
    if summed:
        ranged = ranged.groupBy(*by).agg(*summed)
    return stored(ranged.withColumn(PART, F.spark_partition_id()))


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a scratch table."""
    path = scratch_path(rows.sparkSession, "ordered")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def parts_of(table: DataFrame) -> int:
    return (table.agg(F.max(PART)).first()[0] or 0) + 1


def _spread(table: DataFrame, group: Sequence[str]) -> DataFrame:
    """(part, group) together, in as many partitions as there are parts."""
    return table.repartition(parts_of(table), PART, *group)


def _own(group: Sequence[str]) -> Column:
    return F.struct(*group)


def _with_borders(table: DataFrame, group: Sequence[str], borders: DataFrame) -> DataFrame:
    """Adds ``_carry``: what the border of the part before says, for rows of the group that it ends with.

    Of borders there is one row per part, so both the window and the broadcast are as small as their number.
    """
    before = Window.orderBy(PART)
    carried = borders.select(PART, F.lag("_last").over(before).alias("_last"), F.lag("_state").over(before).alias("_state"))
    goes_on = F.col("_last").eqNullSafe(_own(group))
    return table.join(F.broadcast(carried), PART).withColumn("_carry", F.when(goes_on, F.col("_state"))).drop("_last", "_state")


def previous(table: DataFrame, group: Sequence[str], order: Sequence[str], names: Sequence[str], alias: str) -> DataFrame:
    """Adds ``alias``: a struct of the named columns in the row before, in its group; NULL in a group's first row."""
    here = Window.partitionBy(PART, *group).orderBy(*order)
    borders = table.groupBy(PART).agg(
        F.max(_own(group)).alias("_last"), F.max_by(F.struct(*names), F.struct(*group, *order)).alias("_state"))
    inside = _spread(table, group).withColumn("_before", F.lag(F.struct(*names)).over(here)).withColumn("_place", F.row_number().over(here))
    return (_with_borders(inside, group, borders)
            .withColumn(alias, F.when(F.col("_place") == 1, F.col("_carry")).otherwise(F.col("_before")))
            .drop("_carry", "_before", "_place"))


def running(table: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, alias: str,
            after_previous: bool = False) -> DataFrame:
    """Adds ``alias``: the sum of ``value`` from the start of the row's group to the row itself.

    Partial sums of a part come first; a group that goes on gets the sum of the parts before. What comes from
    ``previous`` has (part, group) together already.
    """
    valued = table.withColumn("_value", value)
    sums = valued.groupBy(PART, *group).agg(F.sum("_value").alias("_sum"))
    ends = sums.groupBy(PART).agg(F.max(_own(group)).alias("_last"), F.max_by("_sum", _own(group)).alias("_sum"))
    so_far = Window.partitionBy("_last").orderBy(PART)  # of a group, one row per part that ends with it
    borders = ends.select(PART, "_last", F.sum("_sum").over(so_far).alias("_state"))
    here = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = (valued if after_previous else _spread(table, group).withColumn("_value", value)).withColumn("_inside", F.sum("_value").over(here))
    return (_with_borders(inside, group, borders)
            .withColumn(alias, F.col("_inside") + F.coalesce(F.col("_carry"), F.lit(0)))
            .drop("_carry", "_inside", "_value"))
