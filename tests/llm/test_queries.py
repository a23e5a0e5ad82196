"""The registered queries against DuckDB or brute force, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillstream.llm import queries
from tests.llm import brute

NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def table(sf):
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{sf}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_document(spark, sf, table, name):
    assert entry.queries()[name](spark, sf).count() == len(table)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    r = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, sf)
    cols = sorted(r.columns)
    assert cols == sorted(df.columns)
    at = [r.columns.index(c) for c in cols]
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(flat(x[c]) for c in cols) for x in df.collect()), key=repr) == sorted((tuple(flat(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_simhash(spark, sf, table):
    fps = {i: brute.fingerprint(t) for i, t, _ in table}
    comp = brute.components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_suffix_dedup(spark, sf, table):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, sf).collect()}
    assert got == brute.removed([(i, t) for i, t, _ in table])


def test_pii(spark, sf, table):
    text = {i: t for i, t, _ in table}
    for r in queries.op8_pii(spark, sf).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(text[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_bpe(spark, sf, table):
    """The query's output against the library."""
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from quillstream.llm import bpe

    t = Tokenizer.from_file(bpe.default_path())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, text, _ in table:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_bpe(spark, sf).collect()} == want


def test_pipeline(spark, sf, table):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == columns
        rows = out.collect()
        seen.append((name, docs.collect(), rows))
        docs = spark.createDataFrame(rows, out.schema)
    stages = {n: (a, b) for n, a, b in seen}
    a, b = stages["exact_dedup"]
    best = {}
    for r in a:
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in b) == sorted(best.values())
    a, b = stages["simhash"]
    fps = {r.doc_id: brute.fingerprint(r.text) for r in a}
    assert sorted(r.doc_id for r in b) == sorted(set(brute.components(fps, lambda x, y: (x ^ y).bit_count() <= 2).values()))
    a, b = stages["mixing"]
    sizes = {}
    for r in a:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    took = {}
    for r in b:
        took[r.source] = took.get(r.source, 0) + len(brute.words(r.text))
    longest = max(len(brute.words(r.text)) for r in a)
    for s, t in brute.targets(sizes).items():
        assert abs(took.get(s, 0) - t) <= longest
    a, b = stages["bpe"]
    assert len(a) == len(b) and sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in a) == sorted(r.decoded_sha256 for r in b)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, b))


def test_pipeline_ends_in_token_ids(spark, sf):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    for r in corpus_pipeline.tokenise(spark, docs, sf).collect():
        assert len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256
