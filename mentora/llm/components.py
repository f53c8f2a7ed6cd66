"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentora.llm.storage import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being the least node reachable.

    Each step aggregates the least neighbour per node (combined before the shuffle) and joins it back, so a node with
    very many neighbours is split by the skew join. Steps are written to the shared folder; they end when the edges
    are stars and stay as they are. Self loops are allowed; an empty table gives an empty one.
    """

    def halves(e: DataFrame) -> DataFrame:
        return e.union(e.select("b", "a"))

    def large_star(e: DataFrame) -> DataFrame:
        both = halves(e)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    scratch = Scratch(edges.sparkSession)
    nodes = scratch.write(halves(edges).select(F.col("a").alias("node")).distinct(), "component-nodes")
    now = scratch.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    # Steps never add edges, so their tables need no more files than these two.
    before, files = None, scratch.files_for(nodes, now)
    while (at := state(now)) != before:
        before = at
        now = scratch.write(small_star(large_star(now)), "component-edges", files)
        scratch.drop_all_but(nodes, now)
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
