"""Connected components of a graph of any size, by alternating large and small stars over stored edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import discard, stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b) with a > b: ties nodes to the smallest node beside them. Minima are aggregates, and hot nodes' edges can be split in the join."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.struct("a").alias("at"), F.least("a", "m").alias("m"))
    tied = both.withColumn("at", F.struct("a")).join(least, "at")
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("at.a").alias("a"), F.col("m").alias("b"))).where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for all nodes that have an edge. edges: a, b, in any order, loops allowed."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    total = mark(now)
    while True:
        new = stored(star(star(now, large=True), large=False), "edges")
        discard(now)
        now, before, total = new, total, mark(new)
        if total == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def mark(edges: DataFrame) -> tuple:
    """Changes whenever the edges do."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
