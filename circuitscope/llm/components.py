"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_scratch, write_scratch

#: Far more rounds than the O(log^2 n) that the method needs for any input that fits a cluster.
MAX_ROUNDS = 100


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that stands in an edge to another node.

    ``component`` is the smallest node reachable. Edges are undirected; repeated edges, self-loops and
    edges with a null end add nothing; an empty input gives an empty result. Each round is one written
    table, so neither edges nor labels ever visit the driver, only a count and a checksum do. A
    node's smallest neighbour is found by a partial aggregate and joined back, so a hub's edges are
    split by the adaptive skew join instead of meeting in one task.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    state, path = write_scratch(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        new, new_path = write_scratch(_small_star(_large_star(state)), "edges")
        drop_scratch(spark, path)
        state, path = new, new_path
    else:
        raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
    # Now every edge leads from a node to its component's smallest node.
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select(F.col("v"), F.col("v")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
