"""Every query with an oracle against DuckDB at the smallest scale; the others run."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from quillstream.plans import catalogue, documents  # noqa: F401  registers


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, con, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    r = con.sql(catalogue.ORACLES[name])
    cols = sorted(r.columns)
    assert cols == sorted(df.columns)
    at = [r.columns.index(c) for c in cols]
    want = sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
    got = sorted((tuple(norm(x[c]) for c in cols) for x in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_scans_are_pruned(spark, sf):
    plan = catalogue.QUERIES["word_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "lang" not in plan


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    plan = catalogue.QUERIES["vector_batch_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
