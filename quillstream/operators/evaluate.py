"""Retrieval quality: recall, reciprocal rank and nDCG, and their averages over a sweep."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as X


def query_metrics(hits: DataFrame, queries: DataFrame, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """hits (by..., rank, text) and queries (query, relevant array) to (by..., recall, mrr, ndcg).

    Recall is the share of expected substrings that some hit holds; nDCG's ideal ranks the hits found first. A query
    without hits scores zero, if by is the query alone.
    """
    told = hits.join(queries.select("query", "relevant"), "query").withColumn("hit", X.is_relevant(F.col("text"), F.col("relevant")))
    found = F.flatten(F.collect_set(F.filter("relevant", lambda e: F.contains(X.fold(F.col("text")), X.fold(e)))))
    m = told.groupBy(*by).agg(
        F.size(F.array_distinct(found)).alias("found"),
        F.max(F.size(F.array_distinct("relevant"))).alias("wanted"),
        F.coalesce(F.lit(1.0) / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.lit(1.0) / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        F.sum(F.col("hit").cast("int")).alias("n"),
    )
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.lit(1.0) / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
    out = m.select(*by, F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(0.0).alias("recall"), "mrr", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))
    if by != ("query",):
        return out
    return queries.select("query").join(out, "query", "left").na.fill(0.0, ["recall", "mrr", "ndcg"])


def leaderboard(rows: DataFrame, by: tuple[str, ...] = ("size", "overlap", "mode")) -> DataFrame:
    """Means by configuration, the best first."""
    means = rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg")], F.count(F.lit(1)).alias("queries"))
    return means.orderBy(F.desc("ndcg"), F.desc("recall"), F.desc("mrr"), *by)


def sweep[I](index: Callable[[int, float], I], search: Callable[[str, I], DataFrame], queries: DataFrame, sizes: Iterable[int], overlaps: Iterable[float], modes: Iterable[str]) -> DataFrame:
    """One row per configuration and query. index makes chunks for a size and overlap (or what stands for them), search ranks them in a mode."""
    modes = tuple(modes)
    out = None
    for size, overlap in product(sizes, overlaps):
        chunks = index(size, overlap)
        for mode in modes:
            rows = query_metrics(search(mode, chunks), queries).select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), F.lit(mode).alias("mode"), "*")
            out = rows if out is None else out.unionByName(rows)
    return out


def labelled(questions: DataFrame) -> DataFrame:
    """Questions whose relevant substrings are known."""
    return questions.where(F.size("relevant") > 0)


def report(board: DataFrame) -> str:
    """A Markdown table of a leaderboard (one row per configuration)."""
    rows = board.collect()
    head = board.columns
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(show(r[c]) for c in head) + " |" for r in rows)])
