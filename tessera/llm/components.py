"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint


#: Rows of a checkpoint's partition at least: late rounds have few edges.
ROWS_A_TASK = 100_000


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are disjoint stars around their v: each u once, and never a v."""
    twice = edges.groupBy("u").count().where("count > 1").select("u")
    inner = edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").select("u")
    return twice.unionByName(inner).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.where("v > u").join(low, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    ``edges`` may hold repeats, self loops, either direction and nulls (dropped: no link).
    Each step is one grouped minimum and one equi-join, so a hub of any degree is folded by
    partial aggregation and split by the skew join. Every round ends in a checkpoint. Only
    counts reach the driver. A node with self loops only has no
    row; an empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = checkpoint(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    while not _stars(e):
        tasks = e.count() // ROWS_A_TASK + 1
        e = checkpoint(_small_star(_large_star(e)).coalesce(tasks))
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
