"""Connected components of a graph of links, by alternating stars.

Each round replaces the links of every node by links to the smallest node it can see (large star:
its larger neighbours; small star: its smaller ones), until every node points at the smallest of its
component. A round is two aggregations with partial sums and two joins that adaptive execution can
split, so a node with very many links is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spokeworks.llm import shared


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; ``component`` is its smallest node.

    ``links`` has two columns of one type, in any direction and with repeats. Null ends and loops
    are ignored. No links give no rows.
    """
    left, right = (F.col(f"`{c}`") for c in links.columns)
    edges = shared.written(
        links.filter(left.isNotNull() & right.isNotNull() & (left != right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "links")
    state = _state(edges)
    while True:
        edges = shared.written(_small_star(_large_star(edges)), "links")
        now = _state(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now


def _state(edges: DataFrame) -> tuple:
    """Count and order-free sum: one row, equal only if nothing moved."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.filter("v > u").join(least, "u").filter("v <> m").selectExpr("v AS u", "m AS v").distinct()
            .unionByName(least.filter("u <> m").selectExpr("u", "m AS v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (edges.join(least, "u").filter("v <> m").selectExpr("v AS u", "m AS v")
            .unionByName(least.selectExpr("u", "m AS v")).distinct())
