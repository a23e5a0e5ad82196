from __future__ import annotations

import pytest

from quillstream.__main__ import main
from quillstream.api import Config, Converter, Pipeline
from quillstream.operators.models import EchoChat


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "cats.md").write_text("# Cats\n\nA cat sat on the mat.\n\n## More\n\nPurring cats sleep.")
    (d / "dogs.html").write_text("<h1>Dogs</h1><p>A dog barks at night.</p>")
    (d / "copy.md").write_text("# Cats\n\nA cat sat on the mat.\n\n## More\n\nPurring cats sleep.")
    (d / "bad.docx").write_bytes(b"nope")
    (d / "skip.bin").write_bytes(b"\0")
    return d


def test_converter(folder):
    c = Converter()
    assert c.convert(str(folder / "dogs.html")).markdown() == "# Dogs\n\nA dog barks at night."
    assert c.convert(b"a,b\n1,2", fmt="csv").markdown(compact=True) == "| a | b |\n| - | - |\n| 1 | 2 |"
    assert c.convert(str(folder / "bad.docx")).status == "failure" and Converter(frozenset({"csv"})).convert(b"x", "x.md").status == "failure"
    assert [x["contextualize"] for x in c.convert(str(folder / "cats.md")).chunks("hybrid", budget=50)] == ["Cats\nA cat sat on the mat.", "Cats\nMore\nPurring cats sleep."]


@pytest.mark.parametrize("chunker", ["window", "hierarchical", "hybrid"])
def test_pipeline(spark, folder, tmp_path, chunker):
    p = Pipeline(spark, str(tmp_path / "store"), Config(chunker=chunker, dim=64))
    assert p.ingest(str(folder)) == {"ingested": 2, "failed": 1, "skipped": 1}
    assert p.ingest(str(folder))["ingested"] == 0
    assert p.stats()["documents"] == 2
    for mode in ("bm25", "vector", "hybrid"):
        best = p.query("purring cats", mode=mode, top_k=3).first()
        assert "Purring" in best["text"], mode
    assert "mat" in p.query("purring cats", mode="bm25", top_k=1, extend=True).first()["text"]
    assert "dog" in p.answer("dog night", EchoChat(), mode="bm25").lower()
    (folder / "dogs.html").write_text("<h1>Dogs</h1><p>Quiet.</p>")
    assert p.ingest(str(folder))["ingested"] == 1 and p.stats()["documents"] == 2


class Chat:
    """Answers with a passage about dogs, whatever is asked; rewords a question as one about barking."""

    def complete(self, prompts):
        return ["1. barks at night\n2) barks\n" if "other wordings" in p else "A dog barks at night." for p in prompts]


def test_query_modes_with_a_chat_model(spark, folder, tmp_path):
    p = Pipeline(spark, str(tmp_path / "store"), Config(dim=64, rrf_k=7, rewrites=2), Chat())
    p.ingest(str(folder))
    best = lambda mode: p.query("purring cats", mode=mode, top_k=1).first()
    assert "Purring" in best("vector")["text"] and "Purring" in best("hybrid")["text"]
    assert "dog" in best("hyde")["text"] and "dog" in best("multi-query")["text"]
    # each of three lists gives 1 / (7 + rank), of hybrid lists fused alike
    assert best("hybrid")["score"] == pytest.approx(2 / 8) and best("multi-query")["score"] <= 3 / 8
    with pytest.raises(ValueError):
        Pipeline(spark, str(tmp_path / "store"), Config(dim=64)).query("x", mode="hyde")


def test_page_range_in_spark(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n")
    (tmp_path / "b.md").write_text("# B")
    got = {r.format: r for r in Converter(page_range="3-2").convert_all(spark, str(tmp_path)).collect()}
    assert got["pdf"].status == "failure" and "page range" in got["pdf"].error and sum(r.status == "success" for r in got.values()) == 1


def test_many_queries_go_in_blocks(spark):
    from quillstream.operators import retrieval

    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(9)], "query int, v array<double>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(retrieval.cosine_scores(vectors, queries, at_once=2)) == rows(retrieval.cosine_scores(vectors, queries)) != []


@pytest.mark.parametrize("bad", [{"size": 0}, {"overlap": 0.95}, {"mode": "x"}, {"chunker": "y"}, {"dim": 0}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_command_line(folder, capsys):
    main(["convert", str(folder / "cats.md")])
    assert capsys.readouterr().out.startswith("# Cats")
    with pytest.raises(SystemExit):
        main(["convert", str(folder / "bad.docx")])


def test_store_views(spark, folder, tmp_path):
    import json

    from pyspark.sql import functions as F

    from quillstream.operators import store

    p = Pipeline(spark, str(tmp_path / "store"), Config(dim=8))
    p.ingest(str(folder))
    docs = {json.loads(r.json)["title"]: json.loads(r.json) for r in p.documents().collect()}
    assert set(docs) == {"Cats", "Dogs"} and docs["Cats"]["has_markdown"] and "markdown" not in docs["Cats"]["metadata"]
    assert "embedding" not in store.tagged_hits(p.store.tables()[1]).columns
    assert p.store.tables()[1].where(F.size("embedding") != 8).count() == 0
    p.store.delete(p.store.tables()[0].where("title = 'Dogs'").first()["source_uri"])
    assert p.stats()["documents"] == 1


def test_mirror_and_content_types(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillstream.sources import files

    df = spark.createDataFrame([("../a/b.html", "# x\n\ny")], "rel_path string, output string")
    files.write_mirror(df, str(tmp_path / "mirror"))
    (found,) = (tmp_path / "mirror").rglob("*.txt")
    assert found.read_text() == "# x\n\ny\n" and "b.html.md" in str(found)
    kinds = spark.createDataFrame([("text/HTML; charset=x",), ("application/pdf",), ("x/y",)], "c string").select(files.format_of_content_type(F.col("c")).alias("f"))
    assert [r.f for r in kinds.collect()] == ["html", "pdf", None]


@pytest.mark.parametrize("url", ["ftp://x.org/a", "http:///a", "http://127.0.0.1/", "http://localhost/x", "http://x.org/"])
def test_urls_that_are_not_fetched(url):
    from quillstream.sources.remote import check_url

    with pytest.raises((ValueError, OSError)):
        check_url(url, frozenset({"127.0.0.1", "localhost"}))
