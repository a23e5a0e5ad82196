"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Groups, largest first, go to the least loaded shard, through a heap. Groups of one
size are interchangeable, so the driver schedules a histogram: how many groups have each size. It has as many rows as there
are different sizes, at most the square root of twice the input's bytes, whatever the number of groups; groups of a size are
then dealt out by rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.exact_dedup import content_hash
from quillstream.runtime import checkpointed

BUCKETS = 1_024


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """Longest processing time first: (size, groups of that size) to (size, groups for each shard), largest first.

    Of equally loaded shards the lowest is next. Where a class has far more groups than shards, all but the last few go in
    one step: those that come before the level at which so many are placed.
    """
    load, out = [0] * shards, []
    for size, n in sorted(classes, reverse=True):
        given = [0] * shards
        if n > 4 * shards and size > 0:
            below = lambda level: [max(0, -(-(level - x) // size)) for x in load]  # noqa: B023, E731  places under it
            low, high = min(load), min(load) + size * n + 1
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if sum(below(mid)) <= n else (low, mid)
            given = below(low)
        heap = [(x + size * k, s) for s, (x, k) in enumerate(zip(load, given))]
        heapq.heapify(heap)
        for _ in range(n - sum(given)):
            x, s = heap[0]
            heapq.heapreplace(heap, (x + size, s))
            given[s] += 1
        load = [x + size * k for x, k in zip(load, given)]
        out.append((size, given))
    return out


def numbered(df: DataFrame, by: str, key: str, order: list[str], name: str) -> DataFrame:
    """df with a number from 0 in each value of `by`, hashed by `key` into BUCKETS so that no task has to hold one whole."""
    dealt = df.withColumn("_k", F.pmod(F.xxhash64(key, *order), F.lit(BUCKETS)).cast("int"))
    counts = dealt.groupBy(by, "_k").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select(by, "_k", (F.sum("_n").over(Window.partitionBy(by).orderBy("_k")) - F.col("_n")).alias("_first"))
    placed = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(by, "_k").orderBy(*order)))
    return placed.join(first, [by, "_k"]).withColumn(name, (F.col("_first") + F.col("_i") - 1).cast("long")).drop("_k", "_first", "_i")


def shard_rows(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1 like an empty one and shares its group; a text of any length is one row. Slots are gapless from
    0 in each shard, in an order that depends on ids and texts only; repeated rows take neighbouring slots. Shards without
    rows are possible if there are fewer groups than shards. Other columns don't matter. An empty table gives an empty
    result.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), content_hash(t).alias("h")))
    groups = checkpointed(rows.groupBy("h").agg(F.sum("size").alias("bytes")))
    classes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toPandas()
    placed = schedule(zip(classes["bytes"].tolist(), classes["n"].tolist()), shards)
    spark = docs.sparkSession
    ends = spark.createDataFrame([(size, [sum(given[: s + 1]) for s in range(shards)]) for size, given in placed], "bytes long, ends array<long>")
    ranked = numbered(groups, "bytes", "h", ["h"], "rank").join(ends, "bytes")
    where = ranked.select("h", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    out = numbered(rows.join(where, "h"), "shard", "doc_id", ["doc_id", "h"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
