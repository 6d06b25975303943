"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least_neighbour(down), "u")
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each component, for every node of (u, v) edges.

    Each round keeps one row for each node and neighbour; a node's neighbours are only ever
    aggregated (their minimum), never collected.  The state is written to the checkpoint folder."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    for _ in range(rounds):
        after = _small_star(_large_star(now)).checkpoint()
        # a star forest: every node has one edge, to a node that has none
        ends = after.select(F.col("u").alias("x"), F.lit(1).alias("starts")).unionByName(after.select(F.col("v").alias("x"), F.lit(0).alias("starts")))
        if ends.groupBy("x").agg(F.sum("starts").alias("n"), F.count("*").alias("edges")).where("n > 1 OR n = 1 AND edges > 1").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = after
    raise RuntimeError("components did not settle")
