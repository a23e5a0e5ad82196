from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quillstream.operators import store, windows
from quillstream.sources import files, remote
from quillstream.streaming.ingest import StreamingChunker, chunk_stream, file_stream, ingest

TEXT = "intro\n# A\na\n## B\nb\n```\n# no\n```\nx\n# C\nlast"


def whole():
    c = StreamingChunker()
    return c.push(TEXT) + c.finish()


def test_chunker_sections():
    assert whole() == [(0, [], "intro"), (1, ["A"], "a"), (2, ["A", "B"], "b\n```\n# no\n```\nx"), (3, ["C"], "last")]


@pytest.mark.parametrize("step", [1, 2, 3, 7])
def test_pieces_give_what_the_whole_gives(step):
    c = StreamingChunker()
    got = [s for i in range(0, len(TEXT), step) for s in c.push(TEXT[i : i + step])] + c.finish()
    assert got == whole()


def test_chunk_stream(spark, tmp_path):
    pieces = [TEXT[i : i + 9] for i in range(0, len(TEXT), 9)]
    rows = [{"doc_id": d, "seq": k, "piece": p} for d in ("x", "y") for k, p in enumerate([*pieces, None])]
    for k in range(0, len(rows), 4):
        f = tmp_path / f"{k:03d}.json"
        f.write_text("\n".join(json.dumps(r) for r in rows[k : k + 4]))
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))  # files come by age
    stream = spark.readStream.schema("doc_id string, seq long, piece string").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = chunk_stream(stream).writeStream.format("memory").queryName("sections").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {d: sorted((r.ordinal, r.heading_path, r.text) for r in spark.table("sections").where(F.col("doc_id") == d).collect()) for d in ("x", "y")}
    assert got["x"] == got["y"] == [(o, h, t) for o, h, t in whole()]


def test_ingest_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one two")
    (folder / "b.txt").write_text("one two")
    (folder / "c.txt").write_text("three")
    s = store.Store(spark, str(tmp_path / "store"), 2)
    s.migrate()

    def chunk(docs):
        c = windows.window_chunks(docs, id_col="id")
        return c.select(F.concat_ws("#", "doc_id", "ordinal").alias("id"), "doc_id", "ordinal", "text", "token_count", F.lit("{}").alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"))

    for k in range(2):  # the second run has lost the stream's own memory
        ingest(file_stream(spark, str(folder)), s, chunk, str(tmp_path / f"checkpoint{k}")).awaitTermination()
    documents, chunks = s.tables()
    assert documents.count() == 2 and sorted(r.text for r in chunks.collect()) == ["one two", "three"]


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# T\n\nx")
    (tmp_path / "d" / "b.CSV").write_text("a,b\n1,2\n")
    (tmp_path / "c.bin").write_bytes(b"\0")
    (tmp_path / "bad.docx").write_bytes(b"nope")
    listed = files.list_files(spark, str(tmp_path)).collect()
    assert [r.rel_path for r in listed] == ["bad.docx", "c.bin", "d/a.md", "d/b.CSV"]
    got = files.parse_documents(files.read_files(spark, str(tmp_path)), id_col="name", format_col="format", content_col="content")
    assert {r.doc_id: r.status for r in got.collect()} == {"a": "success", "b": "success", "c": "failure", "bad": "failure"}
    assert files.read_files(spark, str(tmp_path), ("csv",)).count() == 1
    out = {r.doc_id: r.output for r in files.render(got.where("status = 'success'")).collect()}
    assert out["a"] == "# T\n\nx"
    (tmp_path / "q.json").write_text(json.dumps({"queries": ["p", {"question": "q", "relevant": ["r"]}]}))
    assert [(r.query, r.relevant) for r in files.load_questions(spark, str(tmp_path / "q.json")).collect()] == [("p", []), ("q", ["r"])]
    assert [r.name for r in files.eval_documents(spark, str(tmp_path)).collect()] == ["a"]


class Tree:
    def __init__(self, options):
        self.root = options["root"]

    def list(self):
        return [f"{self.root}/a.txt", f"{self.root}/s/b.txt"]

    def read(self, path):
        return path.encode()


def test_remote_source(spark):
    remote.register(spark)
    from quillstream.runtime import ship

    ship(spark)
    df = spark.read.format("remote_documents").option("kind", "tests.test_streaming:Tree").option("root", "/r").option("filesPerPartition", "1").load()
    assert sorted((r.rel_path, bytes(r.content)) for r in df.collect()) == [("a.txt", b"/r/a.txt"), ("s/b.txt", b"/r/s/b.txt")]


@pytest.mark.parametrize("address, blocked", [("10.0.0.1", True), ("127.0.0.1", True), ("::ffff:192.168.0.1", True), ("169.254.1.1", True), ("8.8.8.8", False), ("::1", True)])
def test_addresses(address, blocked):
    assert remote.is_blocked_address(address) is blocked


def test_queue_payload():
    assert remote.decode_ref(remote.encode_ref("u", "n", "r")) == {"uri": "u", "name": "n", "rel_path": "r"}
