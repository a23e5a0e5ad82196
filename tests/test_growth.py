"""What the queries move and hold when tables are larger, and rows that small tables don't have."""

from __future__ import annotations

import random
import re
import shutil
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstream.operators import retrieval, windows
from quillstream.plans import catalogue, documents  # noqa: F401  registers


@pytest.fixture
def no_broadcast(spark):
    """Plans as of tables too large to be broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moved(df) -> str:
    """The columns that the plan's exchanges take in."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return "\n".join(re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (\[.*\])", plan))


def with_tables(tmp_path: Path, sf: str, **tables: pa.Table) -> str:
    """A folder of the smallest tables, some of them given."""
    for p in Path(sf).glob("*.parquet"):
        shutil.copyfile(p, tmp_path / p.name)
    for name, t in tables.items():
        pq.write_table(t, tmp_path / f"{name}.parquet")
    return str(tmp_path)


def same(spark, folder: str, name: str) -> None:
    """The query's rows are those of its SQL."""
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, folder).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def texts(n: int, seed: int = 0) -> list[str | None]:
    r = random.Random(seed)
    out = [None if r.random() < 0.1 else r.choice([" ", " ", "\n \t", " "]).join(r.choice(["a", "B", "b_c", "d-d", "É", "é", "x9", "...", "b"]) for _ in range(r.randrange(0, 40))) for _ in range(n)]
    return out + out[: n // 4]


def ranked(df) -> list[tuple]:
    return sorted((r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


QUESTIONS = [("p", "a b c"), ("q", "É d b b"), ("r", "nothing"), ("s", None)]


@pytest.mark.parametrize("named", [int, str])
@pytest.mark.parametrize("unique", [True, False])
def test_best_rows_are_those_of_all_scores(spark, named, unique):
    t = texts(60)
    chunks = spark.createDataFrame([(named(i if unique else i // 2), x) for i, x in enumerate(t)], f"doc_id {'int' if named is int else 'string'}, text string").repartition(5)
    q = spark.createDataFrame(QUESTIONS, "query string, text string")
    s = retrieval.bm25_scores(chunks, q).withColumn("score", F.round("score", 9))
    for at_once in (10, 2):
        assert ranked(retrieval.bm25_top(chunks, q, 4, digits=9, at_once=at_once)) == ranked(retrieval.top_k(s, 4)) != []


@pytest.mark.parametrize(("size", "overlap"), [(5, 0.0), (7, 0.4), (4, 0.9), (300, 0.05)])
def test_windows_are_scored_without_being_written(spark, size, overlap):
    docs = spark.createDataFrame(list(enumerate(texts(60))), "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(QUESTIONS, "query string, text string")
    chunks = windows.window_chunks(docs, size=size, overlap=overlap).select((F.col("doc_id") * 100000 + F.col("ordinal")).alias("id"), "text")
    s = retrieval.bm25_scores(chunks, q, id_col="id").withColumn("score", F.round("score", 9))
    got = retrieval.bm25_windows(docs, q, 5, size=size, overlap=overlap, digits=9).withColumn("id", F.col("doc_id") * 100000 + F.col("ordinal"))
    assert ranked(got) == ranked(retrieval.top_k(s, 5)) != []


def test_pieces_make_no_difference(spark, monkeypatch):
    from quillstream.operators import lexical

    t = pa.array(texts(60))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(t))), t], ["id", "text"])
    vocab = pa.array(["a", "b", "c", "É"])
    schema = pa.schema([("query", pa.int32()), ("id", pa.int64()), ("ordinal", pa.int64()), ("score", pa.float64())])
    run = lambda: [b.to_pylist() for b in lexical.best_rows(vocab, (6, 4), np.ones(4), 5.0, [(0, 0, 1), (1, 0, 2), (3, 1, 1)], pa.array([0, 1], pa.int32()), 3, None, 1.2, 0.75, schema)(iter([batch]))]
    want = run()
    monkeypatch.setattr(lexical, "BYTES", 50)
    monkeypatch.setattr(lexical, "PAIRS", 7)
    assert run() == want and len(want[0]) == 6


@pytest.mark.parametrize("name", ["bm25_batch", "eval_metrics", "eval_leaderboard", "hybrid_topk", "multi_query"])
def test_no_text_or_term_but_of_hits_is_shuffled(spark, sf, no_broadcast, monkeypatch, name):
    monkeypatch.setattr(retrieval, "spread", lambda df: df)
    got = moved(catalogue.QUERIES[name](spark, sf).repartition(1)).splitlines()
    assert got and not [x for x in got if re.search(r"\b(term|tf|text)#", x) and "query#" not in x]


def test_document_frequencies_are_counted_without_ids(spark, sf, no_broadcast):
    assert "term#" in (got := moved(retrieval.postings(catalogue.table(spark, sf, "documents")).df)) and "id#" not in got


@pytest.mark.parametrize("name", ["bm25_df", "bm25_idf", "bm25_topk", "bm25_batch"])
def test_repeated_ids(spark, sf, tmp_path, name):
    d = pq.read_table(f"{sf}/documents.parquet").slice(0, 30)
    ids = [i // 2 for i in range(30)]
    same(spark, with_tables(tmp_path, sf, documents=d.set_column(0, "doc_id", pa.array(ids, pa.int64()))), name)


def test_boxes_of_one_place_are_compared_once(spark, sf, tmp_path, no_broadcast):
    """Ten times the parts, dealt over as many places: the same pairs of places."""
    p = pq.read_table(f"{sf}/part.parquet")
    k = p["p_partkey"].to_numpy()
    more = pa.concat_tables(p.set_column(p.schema.get_field_index("p_partkey"), "p_partkey", pa.array(k + 2000 * i, pa.int64())) for i in range(10))
    folder = with_tables(tmp_path, sf, part=more)
    same(spark, folder, "iou_match")
    cells = [x for x in moved(catalogue.QUERIES["iou_match"](spark, folder)).splitlines() if "cx#" in x]
    assert cells and not any("id_a#" in x for x in cells)


def test_boxes_that_repeat_an_id(spark, sf, tmp_path):
    p = pq.read_table(f"{sf}/part.parquet")
    at = p.schema.get_field_index("p_size")
    same(spark, with_tables(tmp_path, sf, part=pa.concat_tables([p, p.set_column(at, p.schema.field(at), pa.array([s.as_py() + 7 for s in p["p_size"]], p.schema.field(at).type))])), "iou_match")


@pytest.mark.parametrize("name", ["html_titles", "html_h1", "html_links"])
def test_pages_as_their_sql_reads_them(spark, sf, tmp_path, name):
    """References cut off or unknown, no title, two of them, attributes, white space of several kinds, no page."""
    bodies = ["a &amp;&amp", "&lt&lt;x_y&gt;", "b\v c\x85d  e", "&copy; &#65;", "  \n\tf  g\r\n", "", "&amp;lt;"]
    pages = [f"<title>{x}</title><h1>{x}</h1><a href=\"/{k}\">{x}</a>" for k, x in enumerate(bodies)]
    pages += [None, "", "<TITLE>x</TITLE><H1>y</H1>", "<h1 class=a>z</h1><h1>w</h1><h1>v</h1>", "<title>a<b>c</title><h1>a<b>c</b></h1>"]
    t = pa.table({"page_id": pa.array(range(len(pages)), pa.int64()), "url": [f"u{i}" for i in range(len(pages))], "html": pages})
    same(spark, with_tables(tmp_path, sf, pages=t), name)


class Taken:
    """A DataFrame that gives the function it is to run in batches."""

    sparkSession = None

    def select(self, *cols):
        return self

    where = select

    def mapInArrow(self, run, schema):
        return run


@pytest.fixture
def held(spark, monkeypatch):
    """Rows of each batch that a step yields from one large batch."""
    from quillstream import runtime
    from quillstream.sources import files

    monkeypatch.setattr(runtime, "ship", lambda s: s)
    monkeypatch.setattr(files, "ship", lambda s: s)
    monkeypatch.setattr(files, "spread", lambda df: df)
    monkeypatch.setattr(files, "PIECE", 20_000, raising=False)
    parse = files.parse_documents(Taken(), id_col="a", format_col="b", content_col="c")
    page = "<html><body><h1>x</h1>" + "<p>some words and <b>more</b> of them</p>" * 10 + "</body></html>"
    pages = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(100)], "format": ["html"] * 100, "content": [page] * 100})
    parsed = list(parse(iter([pages])))
    nodes = pa.Table.from_batches(parsed).select(["doc_id", "nodes"]).combine_chunks().to_batches()
    assert len(nodes) == 1
    return parsed, lambda step: list(step(iter(nodes)))


@pytest.mark.parametrize("name", ["html_nodes, html_furniture", "markdown", "json", "xml", "archive", "hierarchical", "hybrid"])
def test_pages_are_worked_on_in_pieces(held, name):
    from quillstream.sources import files

    parsed, run = held
    if name in ("markdown", "json", "xml", "archive"):
        parsed = run(files.render(Taken(), name))
    elif name in ("hierarchical", "hybrid"):
        parsed = run(files.chunk_documents(Taken(), name))
    ids = [i for b in parsed for i in dict.fromkeys(b.column(0).to_pylist())]
    assert ids == [str(i) for i in range(100)] and max(len(set(b.column(0).to_pylist())) for b in parsed) < 60


@pytest.mark.parametrize("name", ["semchunk", "semchunk_words"])
def test_texts_are_split_in_pieces(spark, monkeypatch, name):
    from quillstream import runtime
    from quillstream.sources import files

    steps = []
    monkeypatch.setattr(files, "PIECE", 1000, raising=False)
    monkeypatch.setattr(runtime, "ship", lambda s: s)
    monkeypatch.setattr(documents, "table", lambda *a: Taken())
    monkeypatch.setattr(Taken, "mapInArrow", lambda self, run, schema: steps.append(run))
    with pytest.raises(AttributeError):
        documents.__dict__[name](spark, "")
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(200), pa.int64()), "text": ["a b. " * 50] * 200})
    assert len(list(steps[0](iter([batch])))) == 50


def test_counts_of_past_documents_are_let_go():
    from quillstream.operators import chunkers

    assert chunkers.Hybrid().count.cache_info().maxsize <= 1 << 10


def test_features_are_summed_in_place(spark, sf, tmp_path, no_broadcast):
    """No feature is shuffled; rows are those of the SQL, also of empty texts, long words and repeated or missing ids."""
    from quillstream.operators import embed

    t = [x and re.sub("[\\xa0\\u2003]", " ", x) for x in texts(40)] + ["", None, "x" * 3000 + " y", "ÀB ab AB_ab", "one"]
    docs = pq.read_table(f"{sf}/documents.parquet").slice(0, len(t)).set_column(1, "text", pa.array(t))
    folder = with_tables(tmp_path, sf, documents=docs)
    assert "f#" not in moved(embed.hash_features(spark.read.parquet(f"{folder}/documents.parquet"), 256).repartition(1))
    same(spark, folder, "hash_embed_terms")
    same(spark, with_tables(tmp_path, sf, documents=docs.set_column(0, "doc_id", pa.array([None if i < 4 else i // 3 for i in range(len(t))], pa.int64()))), "hash_embed_terms")
