"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Star rounds halve the longest path at least; a graph that needs more than this many has an error in its edges.
MAX_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest one around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``: the smallest node that can be reached from it.

    Alternating large and small stars: each round is two aggregations and two joins on the edges, whose number never
    grows, and ends in a checkpoint. The driver sees two numbers a round. Loops, repeated edges and an empty table are
    fine; edges with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct().checkpoint()
    # 32 bits of each hash, so that the sum can't overflow.
    state = F.struct(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(F.xxhash64("a", "b"), 32)))
    seen = edges.agg(state.alias("s")).first()["s"]
    for _ in range(MAX_ROUNDS):
        edges = _small_star(_large_star(edges)).where("a <> b").distinct().checkpoint()
        now = edges.agg(state.alias("s")).first()["s"]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
