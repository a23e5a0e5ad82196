"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Sources share `share` times all words by weight. A source stops at `epochs` times its own words, and what it can't take is
shared again by weight until none is above. That fixed point is min(cap, level * weight) for one water level, found from
running sums over the sources in the order in which they fill up. Each document is then repeated whole floor(target/size)
times, and the fraction left is taken from documents in a seeded order until the source's target is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.runtime import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """sources (source, size) to (source, size, target): one row a source, which is pre-aggregated."""
    ranked = sources.withColumn("r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("r") - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = ranked.withColumn("w", weight).withColumn("cap", F.col("size") * F.lit(float(epochs)))
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("r").asc())
    run = caps.withColumn("full", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")).withColumn("open", F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("all", F.sum("size").over(Window.partitionBy()))
    level = run.withColumn("level", (F.col("all") * F.lit(float(share)) - F.col("full")) / F.col("open"))
    # the level holds from the first source that it does not fill up
    settled = level.withColumn("at", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "r", "level"))).over(Window.partitionBy()))
    return settled.select("source", "size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at")["level"] * F.col("w"))).alias("target"))


def row_key(id_col: str, text_col: str, seed: str = "7") -> Column:
    """What orders rows, by id and text: rows without an id, or with one and the same, don't stand together."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: str = "7") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and key, which row_key gives.

    A null or empty text has size 0 and nothing of it is taken; a null source is a source of its own, last in rank; null
    ids are ordered as the word null. The order depends on ids, texts and seed only, so reruns agree; repeated rows count
    one by one; a text of any length is counted whole; other columns don't matter. An empty table gives an empty result. In
    each source one document at most is taken in part.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_key(id_col, text_col, seed).alias("key"))
    rows = checkpointed(base.withColumn("k", F.substring("key", 1, 3)))
    cells = rows.groupBy("source", "k").agg(F.sum("size").alias("cell"))
    targets = water_fill(cells.groupBy("source").agg(F.sum("cell").alias("size")), weights, share, epochs).withColumnRenamed("size", "source_size")
    before = cells.withColumn("before", F.sum("cell").over(Window.partitionBy("source").orderBy("k")) - F.col("cell"))
    plan = before.join(targets, before["source"].eqNullSafe(targets["source"])).select(before["source"].alias("s"), F.col("k").alias("kk"), "before", "source_size", "target")
    inner = rows.withColumn("inside", F.sum("size").over(Window.partitionBy("source", "k").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    met = inner.join(plan, inner["source"].eqNullSafe(plan["s"]) & (inner["k"] == plan["kk"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before") - F.col("inside")))
    return met.withColumn("whole", whole).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"), "key")


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as often as the mix takes them, columns unchanged; the one of a source taken in part counts whole from half on.

    Rows with equal ids and texts are repeated alike. Texts without words aren't taken. An empty table stays empty.
    """
    times = F.max(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)).cast("int")
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col).groupBy("key").agg(times.alias("_times")).where("_times > 0").withColumnRenamed("key", "_key")
    rows = docs.join(taken, row_key(id_col, text_col) == F.col("_key"))
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).drop("_copy")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5('7:' || COALESCE(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(COALESCE(text, ''))) AS k FROM documents),
s AS (SELECT source, SUM(size) AS sz FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, sz * 2.0::DOUBLE AS cap FROM r),
f AS (SELECT *, SUM(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap AS full_,
             SUM(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_, SUM(sz) OVER () AS total FROM w),
l AS (SELECT *, (total * 1.5::DOUBLE - full_) / open_ AS level FROM f),
a AS (SELECT level AS lv FROM l WHERE level * w <= cap ORDER BY cap / w, r LIMIT 1),
t AS (SELECT source, CAST(sz AS BIGINT) AS source_size, COALESCE(LEAST(cap, (SELECT lv FROM a) * w), cap) AS target FROM l),
c AS (SELECT d.doc_id, d.k, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
             SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before_
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, k AS key,
       CAST(whole * size + GREATEST(0, LEAST(size, CAST(round(target - whole * source_size) AS BIGINT) - before_)) AS BIGINT) AS taken
FROM c
"""
