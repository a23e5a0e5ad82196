"""Pieces of the oracles' SQL (DuckDB)."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def terms(x: str) -> str:
    return rf"list_transform(list_filter(string_split_regex(COALESCE({x}, ''), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), lambda x: {fold('x')})"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(COALESCE({x}, ''), '\s+'), lambda x: x <> '')"


def chunks(size: int = 300, overlap: float = 0.05) -> str:
    """CTEs w, chunks(doc_id, ordinal, token_count, text)."""
    step = size - min(int(size * overlap + 0.5), size - 1)
    return f"""w AS (SELECT doc_id, {words('text')} AS w FROM documents),
chunks AS (SELECT doc_id, CAST(i AS BIGINT) AS ordinal, CAST(len(w[i * {step} + 1 : i * {step} + {size}]) AS BIGINT) AS token_count,
             array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS text
           FROM (SELECT doc_id, w, unnest(range(0, CAST(CASE WHEN len(w) > {size} THEN ceil((len(w) - {size}) / {step}.0) ELSE 0 END AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0))"""


def bm25(corpus: str, queries: str, name: str = "bm25") -> str:
    """CTEs ending in name(query, id, score): corpus has (id, text), queries has (query, text)."""
    n = name
    return f"""{n}_t AS (SELECT id, {terms('text')} AS t FROM {corpus}),
{n}_s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {n}_t),
{n}_q AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest({terms('text')}) AS term FROM {queries}) GROUP BY query, term),
{n}_f AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM {n}_t) WHERE term IN (SELECT term FROM {n}_q) GROUP BY id, length, term),
{n}_d AS (SELECT term, count(*) AS df FROM {n}_f GROUP BY term),
{n} AS (SELECT query, id, SUM(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl)) * times) AS score
        FROM {n}_f JOIN {n}_d USING (term) CROSS JOIN {n}_s JOIN {n}_q USING (term) GROUP BY query, id HAVING SUM(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl)) * times) > 0)"""


COSINE = "COALESCE(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / nullif(sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])), 0), 0)"


def cosine(a: str, b: str) -> str:
    return COSINE.format(a=a, b=b)


def top(scores: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM {scores}) WHERE rank <= {k})"


def rrf(lists: str, name: str) -> str:
    return f"{name} AS (SELECT query, id, SUM(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query, list_ix ORDER BY score DESC, id) AS r FROM {lists}) GROUP BY query, id)"
