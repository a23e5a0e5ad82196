from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.functions import vectors as V
from quillstream.operators import chunkers as C
from quillstream.operators import embed, evaluate, layout, models, retrieval, store, windows
from quillstream.operators.layout import Box


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("expr, want", [
    (lambda: X.terms(F.lit("Ä-b C1")), ["Ä", "b", "c1"]), (lambda: X.words(F.lit("  a\tb c ")), ["a", "b", "c"]), (lambda: X.words(F.lit("")), []), (lambda: X.is_heading_line(F.lit("#tag")), False), (lambda: X.is_heading_line(F.lit("  ## x")), True),
    (lambda: X.unescape_html(F.lit("&amp;lt; a\\_b")), "&lt; a_b"), (lambda: X.escape_underscores(F.lit("a_b\\_c")), "a\\_b\\_c"), (lambda: X.normalize_space(F.lit("“a”  …")), '"a" ...'), (lambda: X.dehyphenate(F.lit("exam-\nple x")), "example x"), (lambda: X.tighten(F.lit("a . ( b )")), "a. (b)"),
    (lambda: X.humanize(F.lit("bar_chart")), "Bar chart"), (lambda: X.table_cell(F.lit("a|\nb")), "a&#124; b"), (lambda: X.is_number(F.lit("1,234.5")), True), (lambda: X.is_number(F.lit("1,23")), False), (lambda: X.is_number(F.lit("x")), False), (lambda: X.normalize_url(F.lit("https://a.b")), "https://a.b/"),
    (lambda: X.file_stem(F.lit("a/b.c.md")), "b.c"), (lambda: X.file_extension(F.lit("x.TXT")), "txt"), (lambda: X.safe_relative(F.lit("../a/./b")), "a/b"), (lambda: X.sniff_delimiter(F.lit("a;b,c;d\n,,,,")), ";"), (lambda: X.sniff_delimiter(F.lit("ab")), ","), (lambda: X.media_seconds(F.lit(1.5)), "1.5"), (lambda: X.media_seconds(F.lit(2.0)), "2"),
    (lambda: X.clean_rewrite(F.lit("2) - foo")), "foo"), (lambda: X.first_heading(F.lit("x\n#hash tag\n# y")), "hash tag"), (lambda: X.title_of(F.lit("x"), F.lit("d/n.md")), "n"), (lambda: X.is_relevant(F.lit("An Apple"), F.array(F.lit("apple"))), True), (lambda: X.looks_like_xml(F.lit(" <!DOCTYPE html>")), False), (lambda: X.looks_like_xml(F.lit("<?xml ?>")), True),
    (lambda: X.xml_dialect(F.lit("<article >")), "jats"), (lambda: X.percent_decode(F.lit("a%20b+c")), "a b+c"), (lambda: X.rate(F.lit(1.0), F.lit(0.0)), None), (lambda: X.strip_image_markers(F.lit("a\n<!-- image -->\nb")), "a\nb"), (lambda: X.contextualize_window(F.array(F.lit("A"), F.lit("B")), F.lit("t")), "# A > B\n\nt"), (lambda: X.ellipsize(F.lit("abc  d"), 3), "abc…"),
    (lambda: X.data_uri_bytes(X.data_uri(F.lit("image/png"), F.lit("hi").cast("binary"))), bytearray(b"hi")),
])
def test_text(spark, expr, want):
    assert one(spark, expr()) == want


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.norm(a)) == 5 and one(spark, V.cosine(a, zero)) == 0 and one(spark, V.cosine(a, a)) == pytest.approx(1) and one(spark, V.normalize(zero)) == [0, 0]
    with pytest.raises(Exception, match="expected 3"):
        one(spark, V.checked(a, 3))


@pytest.mark.parametrize("s", ["", "a", "hello", "Ünïcode ☃", "x" * 50])
def test_fnv(spark, s):
    h = embed.fnv1a(s.encode())
    got = one(spark, V.fnv1a(F.lit(s)))
    assert (got["hi"] << 32 | got["lo"]) == h
    assert one(spark, V.hash_index(V.fnv1a(F.lit(s)), 1000)) == h % 1000 and one(spark, V.hash_sign(V.fnv1a(F.lit(s)))) == (-1.0 if h >> 63 else 1.0)


def test_hash_embedding_agrees_with_its_expression(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "Zed")], "doc_id long, text string")
    want = embed.HashEmbedder(64).embed(["a b a", "", "Zed"])
    got = np.zeros((3, 64))
    for r in embed.hash_features(df, 64).collect():
        got[r.doc_id - 1, r.idx] = r.value
    assert np.allclose(got, want)
    assert [len(r.embedding) for r in embed.embed_column(df, lambda: embed.HashEmbedder(64)).collect()] == [64] * 3


@pytest.mark.parametrize("n, size, overlap", [(0, 10, 0.2), (1, 10, 0.2), (10, 10, 0.2), (11, 10, 0.2), (18, 10, 0.2), (19, 10, 0.2), (100, 10, 0.0), (7, 2, 0.5)])
def test_windows(spark, n, size, overlap):
    df = spark.createDataFrame([(1, " ".join(map(str, range(n))))], "doc_id long, text string")
    got = [r.text.split() for r in windows.window_chunks(df, size=size, overlap=overlap).orderBy("ordinal").collect()]
    step, want, at = size - windows.overlap_words(size, overlap), [], 0
    while n:
        want.append([str(x) for x in range(at, min(at + size, n))])
        if at + size >= n:
            break
        at += step
    assert got == want


MD = "intro\n# A\na\n## B\nb\n```\n# no\n```\n### C\n# D #\nd\n#tag\n"


def test_sections(spark):
    rows = windows.markdown_sections(spark.createDataFrame([(1, MD)], "doc_id long, text string")).orderBy("section").collect()
    assert [(r.heading_path, r.body.strip()) for r in rows] == [([], "intro"), (["A"], "a"), (["A", "B"], "b\n```\n# no\n```"), (["A", "B", "C"], ""), (["D"], "d\n#tag")]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a"), (3, "")], "doc_id long, text string")
    got = {r.id: r.score for r in retrieval.bm25_scores(docs, spark.createDataFrame([(0, "b b x")], "query int, text string")).collect()}
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    assert got == {1: pytest.approx(2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (4 / 3))))}


def test_rrf(spark):
    lists = spark.createDataFrame([(0, 0, "a", 3.0), (0, 0, "b", 2.0), (0, 1, "b", 9.0), (0, 1, "c", 1.0)], "query int, list_ix int, id string, score double")
    got = {r.id: r.score for r in retrieval.rrf(lists).collect()}
    assert got == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62 + 1 / 61), "c": pytest.approx(1 / 62)}


def test_modes():
    assert retrieval.parse_mode(" Keyword ") == "bm25" and retrieval.clamp_top_k(None) == 5 and retrieval.clamp_top_k(1000) == 100 and retrieval.clamp_top_k(0) == 1
    with pytest.raises(ValueError):
        retrieval.parse_mode("nope")


def test_metrics(spark):
    hits = spark.createDataFrame([(0, 1, "none"), (0, 2, "has Foo"), (0, 3, "foo bar"), (1, 1, "x")], "query int, rank int, text string")
    qs = spark.createDataFrame([(0, ["foo", "bar", "baz"]), (1, ["y"]), (2, ["z"])], "query int, relevant array<string>")
    got = {r.query: r for r in evaluate.query_metrics(hits, qs).collect()}
    dcg, ideal = 1 / math.log2(3) + 1 / math.log2(4), 1 + 1 / math.log2(3)
    assert (got[0].recall, got[0].mrr, got[0].ndcg) == (pytest.approx(2 / 3), 0.5, pytest.approx(dcg / ideal)) and got[1].ndcg == got[2].recall == 0


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"), 2)
    s.migrate()
    doc = lambda i, src, h: (i, src, "t", h, '{"metrics": {}}', "c")
    chunk = lambda i, d: (i, d, 0, "x", 1, "{}", [1.0, 0.0])
    docs = spark.createDataFrame([doc("1", "a", "h1"), doc("2", "b", "pending:h2")], store.STORED_DOCUMENT)
    s.add(docs, spark.createDataFrame([chunk("c1", "1"), chunk("c2", "2")], store.STORED_CHUNK))
    assert s.find_by_hash("h1").count() == 1
    s.prune()
    assert [r.id for r in s.tables()[0].collect()] == ["1"] and [r.id for r in s.tables()[1].collect()] == ["c1"]
    with pytest.raises(Exception, match="expected 2"):
        s.add(docs, spark.createDataFrame([("c3", "2", 0, "x", 1, "{}", [1.0])], store.STORED_CHUNK))
    assert s.tables()[0].count() == 1  # the old version stays
    s.add(spark.createDataFrame([("1", "a", "new", "h1", "{}", "later")], store.STORED_DOCUMENT), spark.createDataFrame([chunk("c9", "1")], store.STORED_CHUNK))
    (row,) = s.tables()[0].collect()
    assert (row.title, row.created_at) == ("new", "c") and [r.id for r in s.tables()[1].collect()] == ["c9"]
    before = s.tables()[1].collect()
    s.compact()
    assert len(s._log()) == 1 and s.tables()[1].collect() == before
    s.delete("a")
    assert s.tables()[0].count() == s.tables()[1].count() == 0
    s.add(docs, spark.createDataFrame([chunk("c1", "1")], store.STORED_CHUNK))  # what was gone may come again
    assert s.tables()[0].count() == 2 and s.tables()[1].count() == 1


def test_store_compacts_by_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT_AT", 3)
    s = store.Store(spark, str(tmp_path / "store"), 2)
    s.migrate()
    for k in range(5):
        s.change(spark.createDataFrame([(str(k), "a", "t", "h", "{}", "c")], store.STORED_DOCUMENT))
    assert len(s._log()) <= 3 and s.tables()[0].count() == 5


# Chunkers


NODES = [{"kind": "heading", "level": 1, "text": "T"}, {"kind": "paragraph", "text": "p one"}, {"kind": "heading", "level": 2, "text": "S"}, {"kind": "list_item", "text": "x", "level": 0, "first_in_list": True}, {"kind": "list_item", "text": "y", "level": 1}, {"kind": "picture"}, {"kind": "paragraph", "text": "hid", "layer": "furniture"}, {"kind": "table", "table": {"rows": [["", "c"], ["r", "1"]], "header_rows": [True, False]}}]


def test_hierarchical():
    got = list(C.hierarchical(NODES))
    assert [(c.text, c.headings) for c in got] == [("p one", ["T"]), ("- x\n    - y", ["T", "S"]), ("r, c = 1", ["T", "S"])]
    assert [i["self_ref"] for c in got for i in c.doc_items] == ["#/texts/1", "#/texts/3", "#/texts/4", "#/tables/0"]
    assert got[1].context() == "T\nS\n- x\n    - y"


@pytest.mark.parametrize("table, want", [([["a", "b"], ["1", "2"]], "1, b = 2"), ([["a"], ["1"], ["2"]], "a = 1. a = 2"), ([["a", "b"]], "a. b")])
def test_triplets(table, want):
    assert C.triplets({"rows": table, "header_rows": [True] + [False] * (len(table) - 1)}) == want


def test_triplets_of_several_headers():
    assert C.triplets({"rows": [["", "g"], ["", "h"], ["r", "1"]], "header_rows": [True, True, False]}) == "r, g.h = 1"


@pytest.mark.parametrize("size", [1, 3, 8, 50])
def test_semantic_split(size):
    text = "One two three. Four five;\n\nsix seven, eight nine ten. " * 3 + "x" * 40
    parts = C.semantic_split(text, size, C.word_tokens)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(parts)) == squeeze(text) and all(C.word_tokens(p) <= size or len(p) == 1 for p in parts)


def test_hybrid():
    long = [{"kind": "heading", "level": 1, "text": "H"}, *[{"kind": "paragraph", "text": f"w{i} " * 5} for i in range(6)], {"kind": "paragraph", "text": "z " * 50}]
    cut = C.Hybrid(budget=12)
    parts = list(cut.chunk(long))
    assert all(C.word_tokens(p.context()) <= 12 for p in parts) and len(parts) > 5
    assert len(list(C.Hybrid(budget=12, merge_peers=False).chunk(long))) >= len(parts)
    assert [p.text for p in C.Hybrid(budget=1000).chunk(long)] == ["\n".join(n["text"] for n in long[1:])]


# Layout


def test_overlaps():
    a, b, c = Box(0, 0, 10, 10, score=0.9, ix=0), Box(1, 1, 9, 9, score=0.8, ix=1), Box(20, 0, 30, 10, score=0.7, ix=2)
    assert [x.ix for x in layout.suppress([b, c, a])] == [0, 2] and layout.iou(a, a) == 1 and layout.iou(a, c) == 0
    table, picture = Box(0, 0, 10, 10, "table", 0.6, ix=0), Box(0, 0, 10, 10.5, "picture", 0.55, ix=1)
    assert [x.label for x in layout.resolve([table, picture, Box(1, 1, 5, 5, "text", 0.9, ix=2)])] == ["table"]
    assert layout.resolve([], [Box(0, 0, 1, 1, text="o")])[0].text == "o"


def test_reading_order_of_two_columns():
    page = [Box(0, 0, 100, 5, "page_header", ix=0), Box(0, 10, 100, 20, "title", ix=1), Box(0, 30, 48, 60, ix=2), Box(0, 65, 48, 90, ix=3), Box(52, 30, 100, 60, ix=4), Box(52, 65, 100, 90, ix=5), Box(0, 95, 100, 99, "page_footer", ix=6)]
    assert [b.ix for b in layout.reading_order(page[::-1], 100)] == [0, 1, 2, 3, 4, 5, 6]


def test_structure_tokens():
    assert layout.otsl_cells("ched lcel nl fcel fcel nl ucel fcel nl".split()) == [{"row": 0, "col": 0, "row_span": 1, "col_span": 2, "header": True}, {"row": 1, "col": 0, "row_span": 2, "col_span": 1, "header": False}, {"row": 1, "col": 1, "row_span": 1, "col_span": 1, "header": False}, {"row": 2, "col": 1, "row_span": 1, "col_span": 1, "header": False}]


def test_assembly():
    cells = [Box(0, 0, 10, 2, text="exam-", ix=0), Box(0, 2.5, 10, 4.5, text="ple", ix=1), Box(0, 20, 4, 22, text="a", ix=2), Box(6, 20, 9, 22, text="1", ix=3), Box(0, 41, 9, 43, text="Fig", ix=4)]
    regions = [Box(0, 0, 10, 5, "text", 0.9, ix=0), Box(0, 19, 10, 23, "table", 0.9, ix=1), Box(0, 30, 10, 40, "picture", 0.9, ix=2), Box(0, 41, 10, 43, "caption", 0.9, ix=3), Box(0, 60, 10, 70, "text", 0.1, ix=4)]
    n = layout.assemble(regions, cells, 100, 100)
    assert [(x["kind"], x.get("text"), x.get("caption")) for x in n] == [("paragraph", "example", None), ("table", None, None), ("picture", None, "Fig")] and n[1]["table"]["rows"] == [["a", "1"]] and n[0]["location"] == [0, 0, 51, 26]
    assert layout.match_cells([Box(0, 0, 5, 5, ix=0), Box(5, 0, 10, 5, ix=1)], [Box(1, 1, 2, 2, ix=7), Box(11, 1, 12, 2, ix=8)]) == {0: [7], 1: [8]}


def test_continuations_and_streaming():
    p = lambda t: {"kind": "paragraph", "text": t}
    pages = [[p("It goes"), {"kind": "picture"}], [p("on and on-")], [p("wards."), p("New.")]]
    whole = layout.merge_continuations([n for page in pages for n in page])
    assert [n.get("text") for n in whole] == ["It goes on and onwards.", None, "New."]
    s = layout.StreamingAssembler()
    assert [n for page in pages for n in s.push(page)] + s.finish() == whole


def test_glyphs():
    g = [Box(i * 6, 0, i * 6 + 5, 10, text=c, ix=i) for i, c in enumerate("ab")] + [Box(15, 0, 20, 10, text="c", ix=2)]
    (line,) = layout.lines_of_glyphs(g)
    assert line.text == "ab c" and [w.text for w in layout.words_of_lines([line])] == ["ab", "c"]


# Models


def test_spectrum_and_recognition():
    import io
    import wave

    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes((np.sin(np.arange(8000) / 5).repeat(2) * 20000).astype("<i2").tobytes())
    x = models.decode_wav(held.getvalue())
    m = models.log_mel(x)
    assert x.shape == (16000,) and m.shape == (80, 100) and m.max() <= 2
    assert models.ctc_decode(np.eye(3)[[1, 1, 0, 1, 2]] * 20, ["", "a", "b"])[0] == "aab"
    page = np.full((20, 5), 255)
    page[3:8] = 0
    assert models.text_lines(page) == [(3, 8)] and models.bilinear(page.astype(np.uint8), 10, 5).shape == (10, 5)
    assert models.interleave([0.0, 5.0], [(0.0, 1.0, "hi")]) == [("picture", 0.0, ""), ("text", 0.0, "[time: 0-1] hi"), ("picture", 5.0, "")]
    assert models.rewrites("1. a\n- b\n2) q", "q") == ["a", "b", "q"] and models.sample_frames(list(range(10)), 2) == [2, 7]


def test_chat_column(spark):
    df = spark.createDataFrame([("[1] yes\n\nQuestion: q",)], "prompt string")
    assert models.complete_column(df, models.EchoChat).first()["answer"] == "yes"


def test_hashes_of_many():
    texts = [b"", b"a", b"hello", "Ünïcode ☃".encode(), b"x" * 300, b"a"]
    assert embed.fnv1a_all(texts).tolist() == [embed.fnv1a(t) for t in texts] and embed.fnv1a_all([]).size == 0
