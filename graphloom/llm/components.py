"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpointed, join_groups


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    Every step is an aggregation by node, combined before it moves, and a join
    of the edges with its result, in which the few nodes with very many edges
    are broadcast; so no node's neighbours are gathered in one task. The number
    of rounds grows with the logarithm of the longest path. The edges of each
    round are checkpointed; once every node hangs on a node that hangs on no
    other, the nodes are at their smallest.
    """
    e = checkpointed(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(rounds):
        n, settled = _state(e)
        if settled:
            break
        # large star: a node's larger neighbours move to its smallest
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_groups(both.where("v > u"), least, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node's smaller neighbours and itself move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_groups(large, low, ["u"], "n", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple[int, bool]:
    """(number of edges, whether each node has one smaller neighbour at most, which has none)."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("n"))
    n, open_ends = nodes.agg(F.sum("down"), F.sum(((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("n") > 1))).cast("long"))).first()
    return n or 0, not open_ends
