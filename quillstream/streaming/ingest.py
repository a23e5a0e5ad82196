"""Structured Streaming: folders of documents ingested batch by batch, chunking with state, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillstream.operators import store
from quillstream.runtime import ship


def file_stream(spark: SparkSession, path: str, *, per_trigger: int = 100, schema: str = "value string") -> DataFrame:
    """Text files as they arrive, one row a file; per_trigger bounds a batch."""
    return spark.readStream.schema(schema).option("wholetext", True).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("source_uri"), F.col("value").alias("text"))


def ingest(stream: DataFrame, table: store.Store, chunk: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """stream (source_uri, text) into a store. chunk: documents (id, text) to stored chunks.

    A batch that comes again finds its hashes stored and adds nothing. A source whose text changed loses its old document.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        documents = table.tables()[0]
        fresh = df.select("source_uri", "text", F.sha2("text", 256).alias("hash")).dropDuplicates(["hash"])
        fresh = fresh.join(documents.select("hash"), "hash", "left_anti").withColumn("id", F.sha2(F.concat_ws("|", "source_uri", "hash"), 256))
        fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("source_uri").orderBy("hash"))).where("_n = 1").drop("_n").persist()
        try:
            if fresh.isEmpty():
                return
            stale = documents.join(fresh.select("source_uri"), "source_uri", "left_semi").select("id")
            rows = fresh.select("id", "source_uri", F.element_at(F.split("source_uri", "/"), -1).alias("title"), "hash", F.to_json(F.struct(F.struct(F.length("text").alias("chars")).alias("metrics"))).alias("metadata"), F.lit("1970-01-01T00:00:00Z").alias("created_at"))
            table.change(rows, chunk(fresh.select("id", "text")), stale)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class StreamingChunker:
    """Text in pieces; sections come out when the next heading line outside fences is complete."""

    buffer: str = ""
    in_fence: bool = False
    headings: list[str] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)
    body: list[str] = field(default_factory=list)
    ordinal: int = 0

    def _section(self) -> list[tuple[int, list[str], str]]:
        text = "\n".join(self.body).strip()
        self.body = []
        if not text:
            return []
        self.ordinal += 1
        return [(self.ordinal - 1, list(self.headings), text)]

    def _line(self, line: str) -> list[tuple[int, list[str], str]]:
        import re

        if re.match(r" {0,3}(```|~~~)", line):
            self.in_fence = not self.in_fence
        elif not self.in_fence and (m := re.match(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line)):
            out = self._section()
            level = len(m[1])
            while self.levels and self.levels[-1] >= level:
                self.levels.pop()
                self.headings.pop()
            self.levels.append(level)
            self.headings.append(m[2] or "")
            return out
        self.body.append(line)
        return []

    def push(self, piece: str) -> list[tuple[int, list[str], str]]:
        *lines, self.buffer = (self.buffer + piece).split("\n")
        return [s for line in lines for s in self._line(line)]

    def finish(self) -> list[tuple[int, list[str], str]]:
        out = self._line(self.buffer) if self.buffer else []
        self.buffer = ""
        return out + self._section()


STATE = "buffer string, in_fence boolean, headings array<string>, levels array<int>, body array<string>, ordinal int"
SECTIONS = "doc_id string, ordinal long, heading_path array<string>, text string"


def chunk_stream(pieces: DataFrame) -> DataFrame:
    """pieces (doc_id, seq, piece; a null piece ends the document) to sections, with a state for each document."""
    ship(pieces.sparkSession)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        c = StreamingChunker()
        if state.exists:
            b, f, h, lv, body, n = state.get
            c = StreamingChunker(b, f, list(h), list(lv), list(body), n)
        out, ended = [], False
        rows = pd.concat(list(frames)).sort_values("seq")
        for p in rows["piece"]:
            if p is None or p != p:
                out += c.finish()
                ended = True
            else:
                out += c.push(p)
        if ended:
            state.remove()
        else:
            state.update((c.buffer, c.in_fence, c.headings, c.levels, c.body, c.ordinal))
        yield pd.DataFrame({"doc_id": [key[0]] * len(out), "ordinal": [o for o, _, _ in out], "heading_path": [h for _, h, _ in out], "text": [t for _, _, t in out]})

    return pieces.groupBy("doc_id").applyInPandasWithState(step, SECTIONS, STATE, "append", "NoTimeout")


def event_counts(events: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event time; what is later than the watermark is dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
