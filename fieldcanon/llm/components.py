"""Connected components of a distributed edge table by alternating large and small stars.

The smallest neighbours are written before they are joined, so that the join has a plain shuffle on
either side and Spark can split a hub, whose edges all have one key, among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = edges.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Take columns ``a, b`` (bigint); return ``node, component`` for every node that is not
    the smallest of its component, ``component`` being that smallest node.

    Nodes without a row are their own component. Loops and repeated edges don't matter. Each
    round is written to the shared folder, so its plan stays short and lost executors cost one
    round at most. Rounds grow with the logarithm of the longest path.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    before = _state(edges)
    while before[0]:
        edges = written(_small_star(written(_large_star(edges), "large")), "small")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
