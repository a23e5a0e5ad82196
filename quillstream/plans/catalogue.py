"""The catalogue of registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import boxes as G
from quillstream.functions import text as X
from quillstream.functions import vectors as V
from quillstream.model import FORMATS
from quillstream.operators import embed, evaluate, retrieval, store, windows
from quillstream.plans import sql as S
from quillstream.runtime import checkpointed, unique_ids

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ASKED = "licensed under the apache license thing of ention"
REWRITES = ("apache license terms", "ention of the thing", ASKED)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scalar functions and tokens


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({S.terms('text')}) AS term FROM documents) GROUP BY term")
def tok_terms(spark, d):
    return table(spark, d, "documents").select(F.explode(X.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, CAST(len({S.words('text')}) AS INTEGER) AS words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS flat, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped,
  CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 80 THEN left(trim(regexp_replace(text, '\s+', ' ', 'g')), 80) || '…' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS short FROM documents""")
def text_forms(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(t, r"\s+", " "))).alias("flat"), F.md5(X.escape_html(t)).alias("escaped"), X.ellipsize(t, 80).alias("short"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, upper(left(replace(event_type, '_', ' '), 1)) || substr(replace(event_type, '_', ' '), 2) AS label FROM events""")
def event_labels(spark, d):
    return table(spark, d, "events").select("event_id", X.rfc3339(F.col("ts")).alias("at"), X.humanize(F.col("event_type")).alias("label"))


# Routing

_EXT = "lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1))"


@query("SELECT page_id, url, " + _EXT + " AS ext, COALESCE(CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN '{f}'" for e, f in FORMATS.items()) + " END, 'html') AS format FROM pages")
def format_route(spark, d):
    formats = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    ext = X.file_extension(F.col("url"))
    return table(spark, d, "pages").select("page_id", "url", ext.alias("ext"), F.coalesce(F.try_element_at(formats, ext), F.lit("html")).alias("format"))


@query("""SELECT doc_id, regexp_matches(ltrim(text), '(?i)^(<\\?xml|<!doctype\\s+[a-gi-z])') AS xml,
  CASE WHEN lower(left(text, 4000)) LIKE '%us-patent%' OR lower(left(text, 4000)) LIKE '%patdoc%' OR lower(left(text, 4000)) LIKE '%pap-v1%' THEN 'uspto'
       WHEN lower(left(text, 4000)) LIKE '%<xbrl%' OR lower(left(text, 4000)) LIKE '%:xbrl%' THEN 'xbrl'
       WHEN lower(left(text, 4000)) LIKE '%jats%' OR regexp_matches(lower(left(text, 4000)), '<article[\\s>]') THEN 'jats' ELSE 'xml' END AS dialect FROM (SELECT page_id AS doc_id, html AS text FROM pages)""")
def xml_sniff(spark, d):
    p = table(spark, d, "pages")
    return p.select(F.col("page_id").alias("doc_id"), X.looks_like_xml(F.col("html")).alias("xml"), X.xml_dialect(F.col("html")).alias("dialect"))


_FIRST = r"string_split(c, chr(10))[1]"


@query(f"""WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CASE n_nationkey % 5 WHEN 0 THEN n_name || ',' || n_regionkey || ',x' WHEN 1 THEN n_name || ';' || n_regionkey || ';a,b;c' WHEN 2 THEN n_name || chr(9) || n_regionkey WHEN 3 THEN n_name || '|' || n_regionkey || '|z' ELSE n_name END || chr(10) || 'a:b:c:d' AS c FROM nation),
n AS (SELECT id, [length({_FIRST}) - length(replace({_FIRST}, ',', '')), length({_FIRST}) - length(replace({_FIRST}, ';', '')), length({_FIRST}) - length(replace({_FIRST}, chr(9), '')), length({_FIRST}) - length(replace({_FIRST}, '|', '')), length({_FIRST}) - length(replace({_FIRST}, ':', ''))] AS n FROM t)
SELECT id, [',', ';', chr(9), '|', ':'][list_position(n, list_max(n))] AS delimiter FROM n""")
def csv_sniff(spark, d):
    k, a, b = F.col("n_nationkey") % 5, F.col("n_name"), F.col("n_regionkey").cast("string")
    line = F.when(k == 0, F.concat(a, F.lit(","), b, F.lit(",x"))).when(k == 1, F.concat(a, F.lit(";"), b, F.lit(";a,b;c"))).when(k == 2, F.concat(a, F.lit("\t"), b)).when(k == 3, F.concat(a, F.lit("|"), b, F.lit("|z"))).otherwise(a)
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), X.sniff_delimiter(F.concat(line, F.lit("\na:b:c:d"))).alias("delimiter"))


# Chunks


@query(f"WITH {S.chunks()} SELECT doc_id, ordinal, token_count, md5(text) AS text_md5 FROM chunks")
def window_chunks(spark, d):
    return windows.window_chunks(table(spark, d, "documents")).select("doc_id", "ordinal", "token_count", F.md5("text").alias("text_md5"))


@query(f"WITH {S.chunks(225, 0.1)} SELECT doc_id, ordinal, token_count, md5(text) AS text_md5 FROM chunks")
def window_chunks_tokens(spark, d):
    return windows.window_chunks(table(spark, d, "documents"), size=300, overlap=0.1, unit="tokens").select("doc_id", "ordinal", "token_count", F.md5("text").alias("text_md5"))


@query(f"WITH {S.chunks()} SELECT doc_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks GROUP BY doc_id")
def chunk_stats(spark, d):
    return windows.window_chunks(table(spark, d, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens"))


@query(f"""WITH {S.chunks()} SELECT a.doc_id, a.ordinal, count(*) AS n_ctx, md5(string_agg(b.text, chr(10) || chr(10) ORDER BY b.ordinal)) AS context_md5
FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND b.ordinal BETWEEN a.ordinal - 1 AND a.ordinal + 1 GROUP BY a.doc_id, a.ordinal""")
def chunk_neighborhood(spark, d):
    c = windows.window_chunks(table(spark, d, "documents"))
    return windows.neighborhood(c).select("doc_id", "ordinal", "n_ctx", F.md5("context").alias("context_md5"))


@query(f"""WITH {S.chunks()}, h AS (SELECT doc_id, max(ordinal) AS ordinal FROM chunks GROUP BY doc_id)
SELECT a.doc_id, a.ordinal, count(*) AS n_ctx, md5(string_agg(b.text, chr(10) || chr(10) ORDER BY b.ordinal)) AS context_md5
FROM h a JOIN chunks b ON a.doc_id = b.doc_id AND b.ordinal BETWEEN a.ordinal - 1 AND a.ordinal + 1 GROUP BY a.doc_id, a.ordinal""")
def hit_context(spark, d):
    c = windows.window_chunks(table(spark, d, "documents"))
    last = c.groupBy("doc_id").agg(F.max("ordinal").alias("ordinal"))
    return windows.neighborhood(c, last).select("doc_id", "ordinal", "n_ctx", F.md5("context").alias("context_md5"))


_MD = "'# ' || source || chr(10) || text || chr(10) || '## ' || lang || chr(10) || 'n ' || n_chars || chr(10) || '### deep' || chr(10) || 'x' || chr(10) || '## ' || lang || chr(10) || 'last'"


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """documents with headings: # source, ## lang, ### deep, ## lang."""
    t = F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n## "), "lang", F.lit("\nn "), F.col("n_chars").cast("string"), F.lit("\n### deep\nx\n## "), "lang", F.lit("\nlast"))
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


@query("""SELECT doc_id, CAST(s AS INTEGER) AS section, CASE s WHEN 1 THEN source WHEN 2 THEN source || ' > ' || lang WHEN 3 THEN source || ' > ' || lang || ' > deep' ELSE source || ' > ' || lang END AS path,
  md5(CASE s WHEN 1 THEN text WHEN 2 THEN 'n ' || n_chars WHEN 3 THEN 'x' ELSE 'last' END) AS body_md5 FROM documents, (SELECT unnest([1, 2, 3, 4]) AS s)""")
def heading_path(spark, d):
    s = windows.markdown_sections(_markdown(spark, d))
    return s.select("doc_id", "section", F.array_join("heading_path", " > ").alias("path"), F.md5("body").alias("body_md5"))


@query(f"SELECT doc_id, source AS title, md5({_MD}) AS markdown_md5 FROM documents")
def first_headings(spark, d):
    return _markdown(spark, d).select("doc_id", X.title_of(F.col("text"), F.lit("x/y.md")).alias("title"), F.md5("text").alias("markdown_md5"))


@query(f"""WITH w AS (SELECT doc_id, source, lang, {S.words('text')} AS w, n_chars FROM documents),
c AS (SELECT doc_id, source AS path, 1 AS s, i, array_to_string(w[i * 285 + 1 : i * 285 + 300], ' ') AS text FROM (SELECT *, unnest(range(0, CAST(CASE WHEN len(w) > 300 THEN ceil((len(w) - 300) / 285.0) ELSE 0 END AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0)
      UNION ALL SELECT doc_id, source || ' > ' || lang, 2, 0, 'n ' || n_chars FROM w UNION ALL SELECT doc_id, source || ' > ' || lang || ' > deep', 3, 0, 'x' FROM w UNION ALL SELECT doc_id, source || ' > ' || lang, 4, 0, 'last' FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, i) - 1 AS ordinal, md5('# ' || path || chr(10) || chr(10) || text) AS context_md5 FROM c""")
def section_chunks(spark, d):
    return windows.section_window_chunks(_markdown(spark, d)).select("doc_id", "ordinal", F.md5("context").alias("context_md5"))


# Dense


def _query_vectors(spark: SparkSession, d: str, most: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.where(F.col("vec_id") < most).select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))


@query(f"SELECT e.vec_id, round({S.cosine('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {S.cosine('e.embedding', 'q.embedding')} DESC, e.vec_id LIMIT 10")
def vector_topk(spark, d):
    s = retrieval.cosine_scores(table(spark, d, "embeddings"), _query_vectors(spark, d, 1))
    return retrieval.top_k(s, 10, by=None).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, {S.cosine('e.embedding', 'q.embedding')} AS score FROM embeddings e, embeddings q WHERE q.vec_id < 20), {S.top('s', 5, 't')}
SELECT query, CAST(rank AS INTEGER) AS rank, id AS vec_id FROM t""")
def vector_batch_topk(spark, d):
    s = retrieval.cosine_scores(table(spark, d, "embeddings"), _query_vectors(spark, d, 20))
    return retrieval.top_k(s, 5).select("query", "rank", F.col("id").alias("vec_id"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first_unit FROM embeddings")
def vector_norms(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(F.element_at(V.normalize(v), 1), 6).alias("first_unit"))


_BYTES = "list_transform(range(1, CAST(octet_length(encode(f)) AS BIGINT) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::INTEGER::UHUGEINT)"
_FNV = f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, {_BYTES}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query(f"""WITH w AS (SELECT doc_id, list_transform({S.words('text')}, lambda x: {S.fold('x')}) AS w FROM documents),
f AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, CASE WHEN len(w) > 1 THEN len(w) ELSE 1 END), lambda i: w[i] || '_' || w[i + 1]))) AS f FROM w),
v AS (SELECT f, {_FNV} AS h FROM (SELECT DISTINCT f FROM f)),
s AS (SELECT doc_id, CAST(h % 256 AS BIGINT) AS idx, SUM(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS v FROM f JOIN v USING (f) GROUP BY ALL)
SELECT doc_id, idx, round(v / sqrt(SUM(v * v) OVER (PARTITION BY doc_id)), 9) AS value FROM s QUALIFY v <> 0""")
def hash_embed_terms(spark, d):
    return embed.hash_features(table(spark, d, "documents"), 256).select("doc_id", "idx", F.round("value", 9).alias("value"))


@query()
def hash_embed_chunks(spark, d):
    """Every window chunk's hash embedding, by the numpy embedder."""
    c = windows.window_chunks(table(spark, d, "documents"))
    return embed.embed_column(c, embed.HashEmbedder).select("doc_id", "ordinal", F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


# BM25


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY term")
def bm25_df(spark, d):
    return retrieval.postings(table(spark, d, "documents")).df


@query(f"""WITH f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM f, n""")
def bm25_idf(spark, d):
    p = retrieval.postings(table(spark, d, "documents"))
    return p.df.crossJoin(F.broadcast(p.stats)).select("term", "df", F.round(retrieval.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"SELECT count(*) AS n, round(avg(len({S.terms('text')})), 6) AS avgdl FROM documents")
def bm25_stats(spark, d):
    return retrieval.postings(table(spark, d, "documents")).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def _asked(spark: SparkSession, text: str = ASKED) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query int, text string")


@query(f"WITH c AS (SELECT doc_id AS id, text FROM documents), q AS (SELECT 0 AS query, '{ASKED}' AS text), {S.bm25('c', 'q')} SELECT id AS doc_id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, id LIMIT 10")
def bm25_topk(spark, d):
    return retrieval.bm25_top(table(spark, d, "documents"), _asked(spark), 10).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH c AS (SELECT doc_id AS id, text FROM documents), q AS (SELECT item_id AS query, text FROM benchmark), {S.bm25('c', 'q')}, {S.top('(SELECT query, id, round(score, 9) AS score FROM bm25)', 5, 't')} SELECT query AS item_id, CAST(rank AS INTEGER) AS rank, id AS doc_id FROM t")
def bm25_batch(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return retrieval.bm25_top(table(spark, d, "documents"), q, 5, digits=9).select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"))


# Fusion

_EMB_DOCS = "c AS (SELECT doc_id AS id, text, embedding FROM documents JOIN embeddings ON doc_id = vec_id), v AS (SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, d, "documents").join(e, "doc_id").select(F.col("doc_id").alias("id"), "text", "embedding")


def _embedded_texts(spark: SparkSession, d: str) -> DataFrame | None:
    """(id, text) of documents with a vector, without moving texts; None where ids repeat and the join makes more rows."""
    docs, ids = table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    if not (unique_ids(docs, "doc_id") and unique_ids(ids, "doc_id")):
        return None
    few = F.broadcast(ids) if ids.count() <= retrieval.HITS_AT_ONCE else ids
    return docs.join(few, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text")


def _hybrid_sql(queries: str, k: int, name: str) -> str:
    n = retrieval.depth(k)
    return f"""{name}_dense AS (SELECT query, id, {S.cosine('embedding', 'qv')} AS score FROM c, {queries}), {S.top(f'{name}_dense', n, f'{name}_a')}, {S.bm25('c', queries, f'{name}_bm')}, {S.top(f'{name}_bm', n, f'{name}_b')},
{name}_lists AS (SELECT query, 0 AS list_ix, id, score FROM {name}_a UNION ALL SELECT query, 1, id, score FROM {name}_b), {S.rrf(f'{name}_lists', f'{name}_f')}, {S.top(f'{name}_f', k, name)}"""


@query(f"WITH {_EMB_DOCS}, q AS (SELECT 0 AS query, '{ASKED}' AS text, embedding AS qv FROM v), {_hybrid_sql('q', 5, 'h')} SELECT id AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 8) AS score FROM h")
def hybrid_topk(spark, d):
    q = _asked(spark).crossJoin(F.broadcast(_query_vectors(spark, d, 1).select("v")))
    h = retrieval.hybrid(_embedded(spark, d), q, 5, id_col="id", text_col="text", vec_col="embedding", texts=_embedded_texts(spark, d))
    return h.select(F.col("id").alias("doc_id"), "rank", F.round("score", 8).alias("score"))


_REWRITES = " UNION ALL ".join(f"SELECT {i} AS query, '{t}' AS text" for i, t in enumerate(REWRITES))


@query(f"""WITH {_EMB_DOCS}, q AS (SELECT query, text, embedding AS qv FROM ({_REWRITES}), v), {_hybrid_sql('q', 20, 'h')},
m AS (SELECT 0 AS query, query AS list_ix, id, score FROM h), {S.rrf('m', 'f')}, {S.top('f', 5, 't')} SELECT id AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 8) AS score FROM t""")
def multi_query(spark, d):
    r = spark.createDataFrame([(0, i, t) for i, t in enumerate(REWRITES)], "query int, list_ix int, text string").crossJoin(F.broadcast(_query_vectors(spark, d, 1).select("v")))
    m = retrieval.multi_query(_embedded(spark, d), r, 5, id_col="id", text_col="text", vec_col="embedding", texts=_embedded_texts(spark, d))
    return m.select(F.col("id").alias("doc_id"), "rank", F.round("score", 8).alias("score"))


@query(f"""WITH {_EMB_DOCS}, s AS (SELECT 0 AS query, id, {S.cosine('c.embedding', 'q.embedding')} AS score FROM c, (SELECT embedding FROM embeddings WHERE vec_id = 7) q), {S.top('s', 5, 't')} SELECT id AS doc_id, round(score, 6) AS score FROM t""")
def hyde(spark, d):
    """The hypothetical answer's vector (that of item 7) in place of the query's."""
    q = table(spark, d, "embeddings").where("vec_id = 7").select(F.lit(0).alias("query"), F.lit(ASKED).alias("text"), F.col("embedding").alias("v"))
    return retrieval.retrieve("hyde", _embedded(spark, d), q, 5).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH l AS (SELECT 0 AS query, 0 AS list_ix, doc_id AS id, n_chars::DOUBLE AS score FROM documents UNION ALL SELECT 0, 1, doc_id, quality * 1.0::DOUBLE FROM labels), {S.rrf('l', 'f')} SELECT id, round(score, 8) AS score FROM f""")
def rrf_fuse(spark, d):
    a = table(spark, d, "documents").select(F.lit(0).alias("query"), F.lit(0).alias("list_ix"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    b = table(spark, d, "labels").select(F.lit(0).alias("query"), F.lit(1).alias("list_ix"), F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    return retrieval.rrf(a.unionByName(b)).select("id", F.round("score", 8).alias("score"))


@query(f"""WITH c AS (SELECT doc_id AS id, text FROM documents), q AS (SELECT 0 AS query, '{ASKED}' AS text), {S.bm25('c', 'q')}, {S.top('bm25', 5, 't')}
SELECT md5(string_agg('[' || rank || '] ' || c.text, chr(10) || chr(10) ORDER BY rank)) AS context_md5, count(*) AS passages FROM t JOIN c USING (id)""")
def answer_context(spark, d):
    docs = table(spark, d, "documents")
    hits = retrieval.bm25_top(docs, _asked(spark), 5).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    return retrieval.answer_context(hits).crossJoin(hits.agg(F.count(F.lit(1)).alias("passages"))).select(F.md5("context").alias("context_md5"), "passages")


# Evaluation


def _eval_sql(size: int) -> str:
    m = f"m{size}"
    return f"""{S.chunks(size)}, cc AS (SELECT doc_id * 100000 + ordinal AS id, text FROM chunks), q AS (SELECT item_id AS query, text, [left(text, 40), right(text, 30)] AS relevant FROM benchmark),
{S.bm25('cc', 'q')}, {S.top('(SELECT query, id, round(score, 9) AS score FROM bm25)', 5, 't')},
j AS (SELECT t.query, t.rank, list_filter(q.relevant, lambda e: contains({S.fold('cc.text')}, {S.fold('e')})) AS f, q.relevant FROM t JOIN cc USING (id) JOIN q ON q.query = t.query),
{m} AS (SELECT query, len(list_distinct(flatten(list(f))))::DOUBLE / 2 AS recall, COALESCE(1.0::DOUBLE / min(CASE WHEN len(f) > 0 THEN rank END), 0) AS mrr,
  CASE WHEN sum(CASE WHEN len(f) > 0 THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN len(f) > 0 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, CAST(sum(CASE WHEN len(f) > 0 THEN 1 ELSE 0 END) AS BIGINT) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0 END AS ndcg
  FROM j GROUP BY query)"""


def _benchmark_questions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text", F.array(F.left(t, F.lit(40)), F.right(t, F.lit(30))).alias("relevant"))


def _bm25_hits(docs: DataFrame, questions: DataFrame, size: int, overlap: float, unique: bool) -> DataFrame:
    """Five chunks of each question, with text. Of the hits' documents alone chunks are written out."""
    q = questions.select("query", "text")
    if not unique:
        c = windows.window_chunks(docs, size=size, overlap=overlap).select((F.col("doc_id") * 100000 + F.col("ordinal")).alias("id"), "text")
        return retrieval.bm25_top(c, q, 5, id_col="id", digits=9, unique=False).join(c, "id")
    hits = checkpointed(retrieval.bm25_windows(docs, q, 5, size=size, overlap=overlap, digits=9))
    few = F.broadcast if hits.count() <= retrieval.HITS_AT_ONCE else lambda df: df
    named = docs.join(few(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    return windows.window_chunks(named, size=size, overlap=overlap).join(few(hits), ["doc_id", "ordinal"])


def _unique_chunks(docs: DataFrame) -> bool:
    """Whether doc_id * 100000 + ordinal is one chunk's: ids don't repeat, and no text has room for so many words."""
    return unique_ids(docs, "doc_id") and not docs.where(F.length("text") >= 200000).limit(1).count()


@query(f"WITH {_eval_sql(300)} SELECT q.query AS item_id, round(COALESCE(recall, 0), 6) AS recall, round(COALESCE(mrr, 0), 6) AS mrr, round(COALESCE(ndcg, 0), 6) AS ndcg FROM q LEFT JOIN m300 USING (query)")
def eval_metrics(spark, d):
    docs, q = table(spark, d, "documents"), _benchmark_questions(spark, d)
    m = evaluate.query_metrics(_bm25_hits(docs, q, windows.SIZE, windows.OVERLAP, _unique_chunks(docs)), q)
    return m.select(F.col("query").alias("item_id"), *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def _board_sql(size: int) -> str:
    return f"SELECT * FROM (WITH {_eval_sql(size)} SELECT {size} AS size, 'bm25' AS mode, round(avg(COALESCE(recall, 0)), 6) AS recall, round(avg(COALESCE(mrr, 0)), 6) AS mrr, round(avg(COALESCE(ndcg, 0)), 6) AS ndcg, count(*) AS queries FROM q LEFT JOIN m{size} USING (query))"


@query(f"SELECT CAST(row_number() OVER (ORDER BY ndcg DESC, recall DESC, mrr DESC, size) AS INTEGER) AS rank, * FROM ({_board_sql(150)} UNION ALL {_board_sql(300)})")
def eval_leaderboard(spark, d):
    docs, q = table(spark, d, "documents"), _benchmark_questions(spark, d)
    unique = _unique_chunks(docs)
    rows = evaluate.sweep(lambda size, overlap: (size, overlap), lambda mode, c: _bm25_hits(docs, q, *c, unique), q, (150, 300), (0.05,), ("bm25",))
    board = evaluate.leaderboard(rows).select("size", "mode", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "queries")
    # as many rows as configurations
    return board.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ndcg"), F.desc("recall"), F.desc("mrr"), "size")))


# Store


@query("SELECT sha256(COALESCE(text, '')) AS hash, min(doc_id) AS keep_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, d):
    h = store.content_hash(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").groupBy(h.alias("hash")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """documents as stored ones: every seventh pending, every fifth without metrics."""
    i = F.col("doc_id")
    meta = F.when(i % 5 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"metrics": {"words": '), F.col("n_chars").cast("string"), F.lit("}}")))
    return table(spark, d, "documents").select(i.alias("id"), F.col("source").alias("source_uri"), F.concat(F.lit("t"), i.cast("string")).alias("title"), F.concat(F.when(i % 7 == 0, store.PENDING).otherwise(""), F.sha2("text", 256)).alias("hash"), meta.alias("metadata"), F.lit("2020-01-01T00:00:00Z").alias("created_at"))


@query("SELECT doc_id AS id FROM documents WHERE NOT (doc_id % 7 = 0 OR doc_id % 5 = 0)")
def prune_incomplete(spark, d):
    s = _stored(spark, d)
    return store.prune_incomplete(s, s.select(F.col("id").alias("doc_id")))[0].select("id")


@query(f"WITH {S.chunks()} SELECT doc_id, ordinal FROM chunks JOIN documents USING (doc_id) WHERE source <> 'src3'")
def delete_by_source(spark, d):
    c = windows.window_chunks(table(spark, d, "documents"))
    return store.delete_by_source(_stored(spark, d), c, "src3")[1].select("doc_id", "ordinal")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 't' || doc_id END AS title, '2020-01-01T00:00:00Z' AS created_at FROM documents
UNION ALL SELECT doc_id + 10000000, 'new', '2021-01-01T00:00:00Z' FROM documents WHERE doc_id % 3 = 0""")
def upsert_latest(spark, d):
    s = _stored(spark, d)
    fresh = s.where("id % 3 = 0").withColumn("title", F.lit("new")).withColumn("created_at", F.lit("2021-01-01T00:00:00Z"))
    return store.upsert(s, fresh.unionByName(fresh.withColumn("id", F.col("id") + 10000000))).select("id", "title", "created_at")


@query("SELECT min(doc_id) AS id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY sha256(text)")
def incremental_ingest(spark, d):
    """Odd documents, given even ones are stored: new texts only, one of each."""
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    return store.new_documents(s.where("id % 2 = 1"), s.where("id % 2 = 0")).select("id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def source_semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def source_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query(f"WITH {S.chunks()} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks")
def store_stats(spark, d):
    docs = table(spark, d, "documents")
    return store.stats(docs, windows.window_chunks(docs))


# Serialisation that SQL can express


@query("SELECT conv_id, count(*) AS turns, md5(string_agg('**' || role || ':** ' || text, chr(10) || chr(10) ORDER BY turn)) AS markdown_md5 FROM conversations GROUP BY conv_id")
def conversation_markdown(spark, d):
    block = F.concat(F.lit("**"), "role", F.lit(":** "), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.md5(joined).alias("markdown_md5"))


@query("""SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name || ', n_nationkey = ' || n_nationkey || '. ' || n_name || ', n_regionkey = ' || n_regionkey AS text FROM nation""")
def table_triplets(spark, d):
    """The nation table's rows as statements: row name, column = value."""
    cells = F.array(*[F.concat("n_name", F.lit(f", {c} = "), F.col(c).cast("string")) for c in ("n_nationkey", "n_regionkey")])
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.array_join(cells, ". ").alias("text"))


@query("""SELECT '| ' || rpad('r_regionkey', greatest(13, max(length(r_regionkey::VARCHAR)))::INTEGER, ' ') || ' | ' || rpad('r_name', greatest(8, max(length(r_name)))::INTEGER, ' ') || ' |' || chr(10) || '|' || repeat('-', greatest(13, max(length(r_regionkey::VARCHAR)))::INTEGER + 2) || '|' || repeat('-', greatest(8, max(length(r_name)))::INTEGER + 2) || '|' || chr(10) ||
  (SELECT string_agg('| ' || lpad(r_regionkey::VARCHAR, (SELECT greatest(13, max(length(r_regionkey::VARCHAR)))::INTEGER FROM region)::INTEGER, ' ') || ' | ' || rpad(r_name, (SELECT greatest(8, max(length(r_name)))::INTEGER FROM region)::INTEGER, ' ') || ' |', chr(10) ORDER BY r_regionkey) FROM region) AS text FROM region""")
def md_table_grid(spark, d):
    """The region table as a padded grid: columns at least two wider than their names, numbers to the right."""
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("a"), F.col("r_name").alias("b"), "r_regionkey")
    g = r.agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "a", "b"))).alias("rows"), F.greatest(F.lit(13), F.max(F.length("a"))).alias("wa"), F.greatest(F.lit(8), F.max(F.length("b"))).alias("wb"))
    pad = lambda c, w: F.concat(c, F.repeat(F.lit(" "), w - F.length(c)))
    head = F.concat(F.lit("| "), pad(F.lit("r_regionkey"), F.col("wa")), F.lit(" | "), pad(F.lit("r_name"), F.col("wb")), F.lit(" |\n|"), F.repeat(F.lit("-"), F.col("wa") + 2), F.lit("|"), F.repeat(F.lit("-"), F.col("wb") + 2), F.lit("|\n"))
    body = F.array_join(F.transform("rows", lambda x: F.concat(F.lit("| "), F.repeat(F.lit(" "), F.col("wa") - F.length(x["a"])), x["a"], F.lit(" | "), pad(x["b"], F.col("wb")), F.lit(" |"))), "\n")
    return g.select(F.concat(head, body).alias("text"))


# Boxes: parts and suppliers as rectangles on pages


def _boxes(spark: SparkSession, d: str, name: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    left, top = (k * 37 % 400 + (3 if name == "b" else 0)).cast("double"), (k * 53 % 500).cast("double")
    return p.select(k.alias(f"id_{name}"), (k % 10).alias("page"), F.struct(left.alias("l"), top.alias("t"), (left + F.col("p_size") + 20).alias("r"), (top + 40).alias("b")).alias(name))


_BOX = "p_partkey AS id, p_partkey % 10 AS page, (p_partkey * 37 % 400 + {dx})::DOUBLE AS l, (p_partkey * 53 % 500)::DOUBLE AS t, (p_partkey * 37 % 400 + {dx} + p_size + 20)::DOUBLE AS r, (p_partkey * 53 % 500 + 40)::DOUBLE AS b"


@query(f"""WITH a AS (SELECT {_BOX.format(dx=0)} FROM part), b AS (SELECT {_BOX.format(dx=3)} FROM part),
j AS (SELECT a.id AS id_a, b.id AS id_b, greatest(least(a.r, b.r) - greatest(a.l, b.l), 0) * greatest(least(a.b, b.b) - greatest(a.t, b.t), 0) AS inter, (a.r - a.l) * (a.b - a.t) AS aa, (b.r - b.l) * (b.b - b.t) AS bb FROM a JOIN b ON a.page = b.page)
SELECT id_a, id_b, round(inter / (aa + bb - inter), 6) AS iou, round(inter / aa, 6) AS share FROM j WHERE inter > 0 QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY inter / (aa + bb - inter) DESC, id_b) = 1""")
def iou_match(spark, d):
    """Each box's best partner on its page.

    Boxes of one place are compared once, under their smallest id, and meet in grid cells, so the join's keys are page and
    cell. Pairs are made twice, for the best score and then for the smallest id that has it: both are plain aggregates, and no
    pair is sorted or shuffled.
    """
    cell = 128
    a, b = F.col("a"), F.col("b")
    every, partner = _boxes(spark, d, "a"), _boxes(spark, d, "b").groupBy("page", "b").agg(F.min("id_b").alias("id_b"))

    def cells(df: DataFrame, c: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(f"{c}.{lo}") / cell), F.floor(F.col(f"{c}.{hi}") / cell))
        return df.withColumn("cx", F.explode(span("l", "r"))).withColumn("cy", F.explode(span("t", "b")))

    def pairs(boxes: DataFrame) -> DataFrame:
        met = cells(boxes, "a").join(cells(partner, "b"), ["page", "cx", "cy"])
        # a pair that shares several cells counts in the one that holds its upper left corner
        corner = (F.floor(F.greatest(a["l"], b["l"]) / cell) == F.col("cx")) & (F.floor(F.greatest(a["t"], b["t"]) / cell) == F.col("cy"))
        return met.where(corner & (G.intersection(a, b) > 0)).withColumn("s", G.iou(a, b))

    top = pairs(every.select("page", "a").distinct()).groupBy("page", "a").agg(F.max("s").alias("most"))
    first = pairs(top).where("s = most").groupBy("page", "a").agg(F.min("id_b").alias("id_b"))
    best = first.join(partner, ["page", "id_b"]).withColumn("s", G.iou(a, b)).withColumn("share", G.overlap_share(a, b))
    # rows that repeat an id keep the best of their boxes
    one = every.join(best, ["page", "a"]).withColumn("n", F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("s"), "id_b"))).where("n = 1")
    return one.select("id_a", "id_b", F.round("s", 6).alias("iou"), F.round("share", 6).alias("share"))


@query(f"SELECT page, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS boxes, CAST(least(greatest(round(512 * min(l) / 600), 0), 511) AS INTEGER) AS l_grid FROM (SELECT {_BOX.format(dx=0)} FROM part) GROUP BY page")
def bbox_union(spark, d):
    a = F.col("a")
    u = _boxes(spark, d, "a").groupBy("page").agg(F.min(a["l"]).alias("l"), F.min(a["t"]).alias("t"), F.max(a["r"]).alias("r"), F.max(a["b"]).alias("b"), F.count(F.lit(1)).alias("boxes"))
    return u.withColumn("l_grid", G.quantize(F.col("l"), F.lit(600)))


# Event time, and relational sanity


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u < INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def events_session(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_discount), 8) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    p = F.col("l_extendedprice")
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(p), 4).alias("sum_base"), F.round(F.sum(p * (1 - F.col("l_discount"))), 4).alias("sum_disc"), F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark, d):
    c, o, li, n = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "nation"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
