"""SimHash near-deduplication by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ by at most two bits, one segment
differs by at most one, so the two share a variant of that segment with one bit wildcarded. Each distinct fingerprint is
indexed under its 64 one-wildcard variants, and fingerprints that agree on a variant are verified.

A variant shared by two or three fingerprints is verified from count, minimum, maximum and xor, which are aggregated
map-side. Variants shared by more (near copies by the thousand) never emit pairs: their fingerprints are indexed anew
under variants with two wildcards of the whole fingerprint, at most 2016 each. Those agree on all other bits, so at most
four share one and all of them are links. Work is linear in the number of fingerprints however they crowd.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.components import connected_components
from quillstream.runtime import checkpointed, ship

SEED, SHINGLE, BLOCK = 42, 3, 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of 3-word shingles (ASCII lower case); zero without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f)], ["doc_id", "x", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp long) to links (a, b) whose components are those of all pairs within two bits."""
    half = F.when(F.col("i") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    bit = F.expr("shiftleft(1L, cast(i % 32 as int))")
    # dealt out before they multiply: partitions of bare fingerprints are small enough to be coalesced into a few.
    # By a hash, as Spark leaves out a second exchange by the same column
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = fps.repartition(parts, F.xxhash64("fp")).select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("fp", "i", F.expr("shiftleft(cast(i as bigint), 32)").bitwiseOR(half.bitwiseAND(F.bitwise_not(bit))).alias("key"))
    shared = checkpointed(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor("fp").alias("x")).where("n > 1"))
    few = shared.where("n <= 3").withColumn("mid", F.when(F.col("n") == 3, F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))).otherwise(F.col("hi")))
    pairs = few.select(F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("lo", "mid"), ("mid", "hi"), ("lo", "hi"))])).alias("p")).select("p.a", "p.b")
    near = pairs.where("a != b AND bit_count(a ^ b) <= 2").distinct()

    crowded = variants.join(shared.where("n > 3").select("key"), "key").groupBy("fp").agg(F.bit_or(F.expr("shiftleft(1L, cast(i as int))")).alias("mask")).repartition(parts, F.xxhash64("fp"))
    # positions (p, q): one in each segment if both variants are crowded, or both in one segment if the other is crowded throughout
    lower, upper = F.expr("mask & 4294967295"), F.expr("shiftrightunsigned(mask, 32)")
    full = F.lit(0xFFFFFFFF)
    one = crowded.select("fp", "mask", (lower == full).alias("low_full"), (upper == full).alias("high_full"), F.explode(F.sequence(F.lit(0), F.lit(62))).alias("p"))
    on = lambda c: F.expr(f"(shiftrightunsigned(mask, {c}) & 1) = 1")
    two = one.where((on("p") & (F.col("p") < 32)) | ((F.col("p") < 32) & F.col("high_full")) | ((F.col("p") >= 32) & F.col("low_full"))).select("*", F.explode(F.sequence(F.col("p") + 1, F.lit(63))).alias("q"))
    crossed = (F.col("p") < 32) & (F.col("q") >= 32) & on("p") & on("q")
    inside = ((F.col("q") < 32) & F.col("high_full")) | ((F.col("p") >= 32) & F.col("low_full"))
    wild = two.where(crossed | inside).selectExpr("p * 64 + q AS pq", "fp & ~(shiftleft(1L, p) | shiftleft(1L, q)) AS v", "shiftleft(1, cast((shiftrightunsigned(fp, p) & 1) * 2 + (shiftrightunsigned(fp, q) & 1) AS int)) AS seen")
    met = wild.groupBy("pq", "v").agg(F.bit_or("seen").alias("seen")).where("bit_count(seen) > 1")
    member = "transform(filter(array(0, 1, 2, 3), k -> (shiftright(seen, k) & 1) = 1), k -> v | shiftleft(cast(shiftright(k, 1) AS bigint), cast(pq div 64 AS int)) | shiftleft(cast(k & 1 AS bigint), cast(pq % 64 AS int)))"
    stars = met.select(F.expr(member).alias("m")).select(F.expr("m[0]").alias("a"), F.explode(F.expr("slice(m, 2, 3)")).alias("b")).distinct()
    return near.unionByName(stars).distinct()


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, x, fp) of each row of docs, x a hash of its text; and (fp, c): the component of each fingerprint."""
    ship(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("x"))
    rows = checkpointed(rows.mapInArrow(_fingerprints, "doc_id long, x long, fp long"))
    fps = rows.select("fp").distinct()
    comps = connected_components(links(fps))
    return rows, checkpointed(fps.join(comps, fps["fp"] == comps["node"], "left").select("fp", F.coalesce("component", "fp").alias("c")))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component).

    Fingerprints link at two or fewer differing bits. Null texts and texts without words have fingerprint zero and link
    like any other. Null ids are passed over when the smallest is taken. Rows may repeat. An empty table gives an empty
    result.
    """
    rows, named = fingerprints(docs, id_col, text_col)
    named = checkpointed(named.join(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(least, "c").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one whole row of each component, columns unchanged: that with the smallest id, null ids last.

    Of rows with one id, or none, a hash of their texts decides; of rows alike in id and text any one stays, whatever the
    other columns hold. Null and empty texts are one component. An empty table stays empty.
    """
    rows, named = fingerprints(docs, id_col, text_col)
    # the best row of a fingerprint, then of a component; both take minima map-side first
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")
    alike = rows.groupBy("fp", "doc_id", "x").agg(F.count(F.lit(1)).alias("n"))
    best = alike.select("fp", F.struct(row.alias("row"), "n").alias("r")).groupBy("fp").agg(F.min("r").alias("r"))
    kept = checkpointed(best.join(named, "fp").groupBy("c").agg(F.min("r").alias("r")).select(F.col("r.row.doc_id").alias("_kept_id"), F.col("r.row.x").alias("_kept_x"), F.col("r.n").alias("_kept_n")))
    met = F.col(id_col).cast("long").eqNullSafe(F.col("_kept_id")) & (F.xxhash64(F.col(text_col)) == F.col("_kept_x"))
    if kept.where("_kept_n > 1").isEmpty():
        return docs.join(kept, met, "left_semi")
    single = docs.join(kept.where("_kept_n = 1"), met, "left_semi")
    several = docs.join(kept.where("_kept_n > 1"), met, "inner").dropDuplicates(["_kept_id", "_kept_x"])
    return single.unionByName(several.select(*[docs[c] for c in docs.columns]))
