"""Connected components of a graph given as edges, by joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import cut_lineage

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable, as (node, root), for every node of ``edges`` (a, b).

    Alternates two star contractions until nothing moves: each node hooks its larger neighbours to the smallest
    one it sees, then its smaller ones.  Rounds grow with the logarithm of the largest component.  Each aggregate
    is combined before the shuffle, and the joins are on the node, so a hub is no group of its own in one task.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut_lineage(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        nxt = cut_lineage(small.where("a <> b").distinct())
        if _sum(nxt) == _sum(now):
            break
        now = nxt
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _sum(edges: DataFrame) -> tuple:
    """A value that tells whether two rounds hold the same set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.min("b"), F.max("a")).first())
