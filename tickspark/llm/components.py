"""Connected components of an edge table: large-star and small-star rounds as joins, lineage cut after each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.spill import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.select("a", F.col("m").alias("b")).unionByName(moved.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def _starred(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("root").alias("root")).where("down > 1 or (down = 1 and root = 1)").isEmpty()


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, component): for every node of the edges (a, b) the smallest node that it is linked with. Rounds go on until all
    edges form stars. parts: see ``cut``."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), parts)
    while not _starred(edges):
        edges = cut(_small_star(_large_star(edges)), parts)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
