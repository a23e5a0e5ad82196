"""The front door: a converter, an ingest-and-query pipeline, and functions over a store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.model import FORMATS, STORED_CHUNK
from quillstream.operators import chunkers, embed, models, retrieval, serialize, store, windows
from quillstream.sources import files
from quillstream.sources.parsers import parse
from quillstream.sources.parsers import pdf as pdf_parser


@dataclass
class Result:
    """One converted document: status and error are data, as in the distributed form."""

    name: str
    format: str | None
    status: str
    nodes: list[dict]
    error: str | None = None

    def markdown(self, **how) -> str:
        return serialize.to_markdown(self.nodes, **how)

    def json(self) -> str:
        return serialize.to_json(self.nodes, self.name)

    def xml(self) -> str:
        return serialize.to_xml(self.nodes)

    def chunks(self, chunker: str = "hierarchical", **how) -> list[dict]:
        cut = chunkers.hierarchical(self.nodes) if chunker == "hierarchical" else chunkers.Hybrid(**how).chunk(self.nodes)
        return [c.row() | {"contextualize": c.context()} for c in cut]


@dataclass
class Converter:
    """Options: formats let in (all if None), pages of PDF files, strict Markdown, compact tables."""

    allowed_formats: frozenset[str] | None = None
    page_range: str | None = None
    strict: bool = False
    compact_tables: bool = False

    def convert(self, source: str | bytes, name: str | None = None, fmt: str | None = None) -> Result:
        """One file by path, or bytes with a name or format; on the driver."""
        if isinstance(source, str):
            name, content = name or source, Path(source).read_bytes()
        else:
            name, content = name or "", source
        fmt = fmt or FORMATS.get(name.rpartition(".")[2].lower())
        stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if fmt is None or self.allowed_formats is not None and fmt not in self.allowed_formats:
            return Result(stem, fmt, "failure", [], f"format not allowed or not known: {name}")
        try:
            nodes = pdf_parser.parse(content, stem, self.page_range) if fmt == "pdf" else parse(fmt, content, stem)
        except Exception as e:  # noqa: BLE001
            return Result(stem, fmt, "failure", [], f"{type(e).__name__}: {e}")
        return Result(stem, fmt, "success", nodes)

    def convert_all(self, spark: SparkSession, path: str) -> DataFrame:
        """A folder, by Spark: (doc_id, format, status, error, nodes)."""
        rows = files.read_files(spark, path, tuple(self.allowed_formats) if self.allowed_formats else None)
        return files.parse_documents(rows.where(F.col("format").isNotNull()), id_col="path", format_col="format", content_col="content", page_range=self.page_range)

    def markdown(self, converted: DataFrame) -> DataFrame:
        return files.render(converted, "markdown", strict=self.strict, compact=self.compact_tables)


@dataclass
class Config:
    """How documents are chunked, embedded and searched; checked when made."""

    chunker: str = "window"
    unit: str = "words"
    size: int = 300
    overlap: float = 0.05
    mode: str = "hybrid"
    top_k: int = 5
    rrf_k: int = 60
    rewrites: int = 4
    dim: int = 1024
    make_embedder: Callable[[], embed.Embedder] | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.chunker not in ("window", "hierarchical", "hybrid") or self.unit not in ("words", "tokens"):
            raise ValueError("chunker: window, hierarchical or hybrid; unit: words or tokens")
        if self.size < 1 or not 0 <= self.overlap < 0.95 or self.dim < 1 or self.top_k < 1 or self.rrf_k < 1 or self.rewrites < 1:
            raise ValueError("size, dim, top_k, rrf_k and rewrites are positive, overlap lies in [0, 0.95)")
        self.mode = retrieval.parse_mode(self.mode)

    def embedder(self) -> Callable[[], embed.Embedder]:
        dim = self.dim
        return self.make_embedder or (lambda: embed.HashEmbedder(dim))


class Pipeline:
    """Ingest into a store and query it."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, chat: models.ChatModel | None = None):
        self.spark, self.config, self.chat = spark, config or Config(), chat
        self.store = store.Store(spark, root, self.config.dim)
        self.store.migrate()

    def chunk(self, parsed: DataFrame) -> DataFrame:
        """Stored chunks (with vectors) of parsed documents whose doc_id is the stored id."""
        c = self.config
        if c.chunker == "window":
            text = files.render(parsed).withColumnRenamed("output", "text")
            rows = windows.section_window_chunks(text, size=windows.window_words(c.size, c.unit), overlap=c.overlap).select("doc_id", "ordinal", F.col("context").alias("text"))
        else:
            rows = files.chunk_documents(parsed, c.chunker, budget=c.size).select("doc_id", "ordinal", F.col("context").alias("text"))
        rows = rows.select(F.sha2(F.concat_ws("#", "doc_id", "ordinal"), 256).alias("id"), "doc_id", "ordinal", "text", X.word_count(F.col("text")).cast("long").alias("token_count"), F.to_json(F.struct(F.lit(c.chunker).alias("chunker"))).alias("metadata"))
        return embed.embed_column(rows, c.embedder()).select(*STORED_CHUNK.names)

    def ingest(self, path: str, converter: Converter | None = None) -> dict[str, int]:
        """New files under a folder. Counts: ingested, skipped (known content), failed. A changed source replaces its old document."""
        converter = converter or Converter()
        raw = files.read_files(self.spark, path, tuple(converter.allowed_formats) if converter.allowed_formats else None).where(F.col("format").isNotNull())
        hashed = raw.select("path", "format", "content", F.sha2("content", 256).alias("hash")).withColumn("id", F.sha2(F.concat_ws("|", "path", "hash"), 256))
        documents = self.store.tables()[0]
        first = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("hash").orderBy("path"))).where("_n = 1").drop("_n")
        fresh = first.join(documents.select("hash"), "hash", "left_anti")
        parsed = files.parse_documents(fresh, id_col="id", format_col="format", content_col="content", page_range=converter.page_range).persist()
        try:
            counts = {r["status"]: r["n"] for r in parsed.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
            good = parsed.where("status = 'success'")
            told = files.render(good).withColumnRenamed("output", "markdown").join(fresh.select(F.col("id").alias("doc_id"), "path", "hash"), "doc_id")
            metrics = F.struct(F.struct(X.word_count(F.col("markdown")).alias("words"), F.length("markdown").alias("chars")).alias("metrics"), F.col("markdown"))
            rows = told.select(F.col("doc_id").alias("id"), F.col("path").alias("source_uri"), X.title_of(F.col("markdown"), F.col("path")).alias("title"), "hash", F.to_json(metrics).alias("metadata"), X.rfc3339(F.current_timestamp()).alias("created_at"))
            stale = documents.join(rows.select("source_uri"), "source_uri", "left_semi").select("id")
            if counts.get("success"):
                self.store.change(rows, self.chunk(good), stale)
            return {"ingested": counts.get("success", 0), "failed": counts.get("failure", 0), "skipped": hashed.count() - sum(counts.values())}
        finally:
            parsed.unpersist()

    def query(self, text: str, *, mode: str | None = None, top_k: int | None = None, extend: bool = False) -> DataFrame:
        """(rank, id, doc_id, ordinal, score, text) of the best chunks; extend adds the chunks around each.

        multi-query and hyde need the pipeline's chat model: for `rewrites` other wordings, or for a hypothetical answer
        whose vector is searched.
        """
        mode = retrieval.parse_mode(mode or self.config.mode)
        if mode in ("multi-query", "hyde") and self.chat is None:
            raise ValueError(f"{mode} needs a chat model")
        texts = models.ask_rewrites(self.chat, text, self.config.rewrites) if mode == "multi-query" else [text]
        sought = [models.ask_hypothetical(self.chat, text)] if mode == "hyde" else texts
        vectors = [[float(v) for v in e] for e in self.config.embedder()().embed(sought)]
        queries = self.spark.createDataFrame([(0, i, t, v) for i, (t, v) in enumerate(zip(texts, vectors))], "query int, list_ix int, text string, v array<double>")
        chunks = self.store.tables()[1]
        hits = retrieval.retrieve(mode, chunks, queries, top_k or self.config.top_k, rrf_k=self.config.rrf_k).select("rank", "id", "score").join(chunks.select("id", "doc_id", "ordinal", "text"), "id")
        if extend:
            around = windows.neighborhood(chunks, hits.select("doc_id", "ordinal"))
            hits = hits.drop("text").join(around.select("doc_id", "ordinal", F.col("context").alias("text")), ["doc_id", "ordinal"])
        return hits.select("rank", "id", "doc_id", "ordinal", "score", "text").orderBy("rank")

    def answer(self, text: str, chat, **how) -> str:
        hits = self.query(text, **how).withColumn("query", F.lit(0))
        row = retrieval.answer_context(hits).select(retrieval.prompt(F.col("context"), F.lit(text)).alias("p")).first()
        return chat.complete([row["p"]])[0] if row else ""

    def stats(self) -> dict[str, int]:
        return store.stats(*self.store.tables()).first().asDict()

    def documents(self) -> DataFrame:
        return store.document_json(self.store.tables()[0])
