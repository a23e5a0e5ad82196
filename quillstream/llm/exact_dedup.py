"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep one row of each.

The aggregation key is (hash, text): Spark compares the texts' bytes whenever hashes agree, so rows share a group only
if their texts are identical. Copies collapse in the map-side aggregation, so a hot group costs one row per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.runtime import checkpointed


def content_hash(text: Column) -> Column:
    """128 bits, as binary."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep is "max" or "min": the id that stays. Null texts count as empty. Null ids lose against any other; a group of null
    ids only has a null keep_id and keeps one row. Of repeated rows (same id, same text) one is kept. An empty table gives
    an empty result. hash_fn may be any function of the text, even a poor one: colliding texts stay apart.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", hash_fn(F.col("t")))
    groups = rows.groupBy("h", "t").agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
    sized = checkpointed(groups.select("h", "group_size", "keep_id"))
    collided = checkpointed(sized.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"))
    nth = Window.partitionBy("doc_id", "h").orderBy("text_sha256")
    one = rows.withColumn("text_sha256", F.sha2("t", 256))
    if collided.isEmpty():
        out = one.select("doc_id", "h", "text_sha256").withColumn("nth", F.row_number().over(nth)).join(sized, "h")
    else:  # texts whose hash is not theirs alone are told apart by the text itself
        nth = Window.partitionBy("doc_id", "h", "t").orderBy("text_sha256")
        plain = one.join(collided, "h", "left_anti").select("doc_id", "h", "text_sha256").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("text_sha256"))).join(sized.join(collided, "h", "left_anti"), "h")
        mixed = one.join(collided, "h", "left_semi").withColumn("nth", F.row_number().over(nth)).join(groups.join(collided, "h", "left_semi"), ["h", "t"])
        out = plain.select("doc_id", "keep_id", "group_size", "nth", "text_sha256").unionByName(mixed.select("doc_id", "keep_id", "group_size", "nth", "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def keep_one_per_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs with one whole row of each group of equal texts: that with the largest (smallest) id; columns unchanged.

    A null text counts as empty when groups are formed and comes out as it was in the row that stays.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    best = {"max": F.max, "min": F.min}[keep]
    key = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(F.col(id_col).alias("i"), F.col(text_col).isNull().alias("n"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(rest)])
    kept = docs.groupBy(content_hash(key).alias("h"), key.alias("t")).agg(best(row).alias("r"))
    made = {id_col: F.col("r.i"), text_col: F.when(~F.col("r.n"), F.col("t"))} | {c: F.col(f"r.c{k}") for k, c in enumerate(rest)}
    return kept.select(*[made[c].alias(c) for c in docs.columns])
