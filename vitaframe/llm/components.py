"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the smallest node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the two-column ``edges``; ``root`` is the smallest node of its component.

    Each round is written to the shared folder, so a lost executor costs at most one round. The
    number of rounds grows with the logarithm of the longest path. Minima are combined before the
    shuffle, and a node with very many edges meets its minimum in a join whose partitions may split.
    """
    a, b = edges.columns
    known = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    known = written(known, "edges")
    mark = None
    for _ in range(rounds):
        state = known.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state.n, state.x) == mark or state.n == 0:
            break
        mark = (state.n, state.x)
        known = written(_small_star(_large_star(known).where("u != v").distinct()).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = known.select(F.col("v").alias("node")).distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
