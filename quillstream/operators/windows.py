"""Window chunking and Markdown sections, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X

SIZE, OVERLAP, WORDS_PER_TOKEN = 300, 0.05, 0.75


def window_words(size: int, unit: str = "words") -> int:
    """A size in tokens is three quarters of it in words."""
    return max(1, int(size * WORDS_PER_TOKEN)) if unit == "tokens" else size


def overlap_words(size: int, overlap: float) -> int:
    if not 0 <= overlap < 0.95:
        raise ValueError("overlap must lie in [0, 0.95)")
    return min(int(size * overlap + 0.5), size - 1)


def windows(words: Column, size: int = SIZE, overlap: float = OVERLAP) -> Column:
    """array<array<string>>: windows of size words; the one that reaches the end is the last."""
    step = size - overlap_words(size, overlap)
    n = F.size(words)
    last = F.when(n > size, F.ceil((n - size) / F.lit(step)).cast("int")).otherwise(0)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<array<string>>"))


def window_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: float = OVERLAP, unit: str = "words") -> DataFrame:
    """(doc_id, ordinal, token_count, text) of texts without markup. A narrow plan: one scan and a generate."""
    w = docs.select(F.col(id_col).alias("doc_id"), X.words(F.col(text_col)).alias("w"))
    cut = w.select("doc_id", F.posexplode(windows(F.col("w"), window_words(size, unit), overlap)).alias("ordinal", "part"))
    return cut.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.size("part").cast("long").alias("token_count"), F.array_join("part", " ").alias("text"))


def markdown_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line, in_fence): fences by a running count of their marks."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("fence", X.is_fence_line(F.col("line")).cast("int"))
    before = F.coalesce(F.sum("fence").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("in_fence", (before % 2 == 1) | (F.col("fence") == 1)).drop("fence")


def markdown_sections(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, heading_path, body): a section for each ATX heading outside fences, and for what comes before.

    The path has, for each level, the last heading seen at it that no shallower heading has followed.
    """
    lines = markdown_lines(docs, id_col, text_col)
    heading = X.is_heading_line(F.col("line")) & ~F.col("in_fence")
    level = F.when(heading, F.length(F.regexp_extract("line", r"^ {0,3}(#{1,6})", 1)))
    title = F.when(heading, F.trim(F.regexp_replace(F.regexp_extract("line", r"^ {0,3}#{1,6}\s*(.*?)\s*$", 1), r"\s+#+$", "")))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = lines.withColumn("level", level).withColumn("title", title).withColumn("section", F.sum(F.when(heading, 1).otherwise(0)).over(order).cast("int"))
    for k in range(1, 7):
        df = df.withColumn(f"at{k}", F.max(F.when(F.col("level") == k, F.col("line_no"))).over(order)).withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(order))
    alive = []
    for k in range(1, 7):
        shallower = F.greatest(*[F.coalesce(f"at{j}", F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1))
        alive.append(F.when(F.col(f"at{k}").isNotNull() & (F.col(f"at{k}") > shallower), F.col(f"h{k}")))
    df = df.withColumn("path", F.filter(F.array(*alive), lambda h: h.isNotNull()))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~heading, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    return df.groupBy("doc_id", "section").agg(F.max_by("path", "line_no").alias("heading_path"), body.alias("body"))


def section_window_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: float = OVERLAP) -> DataFrame:
    """Window chunks of each section with its headings: (doc_id, ordinal, heading_path, text, context)."""
    s = markdown_sections(docs, id_col=id_col, text_col=text_col).withColumn("w", X.words(F.col("body")))
    cut = s.select("doc_id", "section", "heading_path", F.posexplode(windows(F.col("w"), size, overlap)).alias("k", "part"))
    out = cut.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "k")).cast("long") - 1)
    text = F.array_join("part", " ")
    return out.select("doc_id", "ordinal", "heading_path", text.alias("text"), X.contextualize_window(F.col("heading_path"), text).alias("context"))


def neighborhood(chunks: DataFrame, hits: DataFrame | None = None, radius: int = 1) -> DataFrame:
    """(doc_id, ordinal, n_ctx, context): each hit's chunk with those around it. With all chunks as hits, lag and lead."""
    if hits is None:
        w = Window.partitionBy("doc_id").orderBy("ordinal")
        around = [F.when(F.abs(F.lag("ordinal", -k).over(w) - F.col("ordinal")) <= radius, F.lag("text", -k).over(w)) for k in range(-radius, radius + 1)]
        kept = F.filter(F.array(*around), lambda t: t.isNotNull())
        return chunks.select("doc_id", "ordinal", F.size(kept).cast("long").alias("n_ctx"), F.array_join(kept, "\n\n").alias("context"))
    h = hits.select(F.col("doc_id").alias("d"), F.col("ordinal").alias("o"))
    # the equal document makes this a hash join; the band is checked on the pairs
    near = h.join(chunks, (h["d"] == chunks["doc_id"]) & chunks["ordinal"].between(h["o"] - radius, h["o"] + radius))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n")
    return near.groupBy(F.col("d").alias("doc_id"), F.col("o").alias("ordinal")).agg(F.count(F.lit(1)).alias("n_ctx"), text.alias("context"))
