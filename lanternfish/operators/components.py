"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, written: Callable[[DataFrame], DataFrame], rounds: int = 100) -> DataFrame:
    """node, component (the least node of its component) for each node that an edge (a, b) names.

    In a large-star step each node points its greater neighbours at the least of its neighbourhood, in a small-star step its
    lesser ones; the edges shrink to one star per component in O(log^2 n) rounds. Each step is an aggregate and a join on
    the node, both of which bear a node with a great many edges. written() cuts the lineage after each round. Edges with a
    null end and loops are dropped; an empty table gives no rows. Components that need more than `rounds` rounds raise.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small)
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == state:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    stars = edges.groupBy("a").agg(F.min("b").alias("b"))
    roots = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
