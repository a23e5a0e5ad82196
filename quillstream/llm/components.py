"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.runtime import checkpointed


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) to (node, component): the smallest node that each can reach; nodes without edges don't show.

    Each round is two aggregations and two joins; a hub's rows are only ever joined, which adaptive execution can split,
    and minima are taken map-side first. Rounds stop when the edges are stars.
    """
    e = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(moved.unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
