"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholiast.llm.store import drop, store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node to the smallest of them: those above the node (large) or below it (small)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each end of an edge the smallest id that its edges reach.

    `edges` has long columns a and b; order, repeats and loops don't matter, null ends are dropped.
    Each round is one job whose result is written to the shared folder; rounds grow with the
    logarithm of the longest path. No edge list or group comes to the driver, and a node's
    neighbours meet only in aggregations with map-side sums and in joins that can be split.
    """
    spark = edges.sparkSession
    start = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = store(start, "edges")
    while not _settled(now):
        new, new_path = store(_star(_star(now, True), False), "edges")
        drop(spark, path)
        now, path = new, new_path
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("id"), "component")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has that one only, and that one has none: one job."""
    several = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    inner = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return several.unionByName(inner).isEmpty()
