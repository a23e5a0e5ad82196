"""The document store: documents and chunks in Parquet, and their maintenance as set operations."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import vectors as V
from quillstream.model import STORED_CHUNK, STORED_DOCUMENT

PENDING = "pending:"


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def new_documents(incoming: DataFrame, stored: DataFrame, *, hash_col: str = "hash", order_col: str = "id") -> DataFrame:
    """Rows whose hash isn't stored yet, one of each hash (the first by order_col)."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(hash_col).orderBy(order_col))).where("_n = 1").drop("_n")
    return first.join(stored.select(hash_col), hash_col, "left_anti").select(*incoming.columns)


def upsert(stored: DataFrame, incoming: DataFrame, *, key: str = "id", version: str | None = None, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The latest row of each key; columns in keep stay as they were first stored. Ties in version go to incoming."""
    v = F.col(version) if version else F.lit(0)
    both = stored.select("*", v.alias("_v"), F.lit(0).alias("_new")).unionByName(incoming.select("*", v.alias("_v"), F.lit(1).alias("_new")))
    cols = stored.columns
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct("_v", "_new")).alias("last")
    first = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct("_new", "_v")).alias("first")
    got = both.groupBy(F.col(key).alias("_k")).agg(last, first)
    return got.select(*[F.col(f"{'first' if c in keep else 'last'}.{c}").alias(c) for c in cols])


def delete_documents(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gone (id): both tables without those documents."""
    return documents.join(gone, "id", "left_anti"), chunks.join(gone.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")


def delete_by_source(documents: DataFrame, chunks: DataFrame, source_uri: str) -> tuple[DataFrame, DataFrame]:
    return delete_documents(documents, chunks, documents.where(F.col("source_uri") == source_uri).select("id"))


def is_incomplete(hash_: Column, metadata: Column) -> Column:
    """Ingest was cut short: a pending hash, or no metrics."""
    return F.startswith(hash_, F.lit(PENDING)) | F.get_json_object(metadata, "$.metrics").isNull()


def prune_incomplete(documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return delete_documents(documents, chunks, documents.where(is_incomplete(F.col("hash"), F.col("metadata"))).select("id"))


def stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks."""
    return documents.agg(F.count(F.lit(1)).alias("documents")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))


def document_json(documents: DataFrame) -> DataFrame:
    """Documents as JSON without their Markdown, which is told by a flag."""
    meta = F.from_json("metadata", "map<string,string>")
    slim = F.map_filter(meta, lambda k, v: k != "markdown")
    return documents.select("id", F.to_json(F.struct("id", "source_uri", "title", "hash", "created_at", slim.alias("metadata"), F.get_json_object("metadata", "$.markdown").isNotNull().alias("has_markdown"))).alias("json"))


def tagged_hits(hits: DataFrame) -> DataFrame:
    """Hits without their vectors."""
    return hits.drop("embedding")


#: Versions since the last whole one before a change writes a whole one again.
COMPACT_AT = 32


@dataclass
class Store:
    """Tables under a folder that all executors reach, as a log of versions.

    A change writes the rows that are new and the ids that are gone, never what is there already; then one log row makes it
    visible. A version counts from its log row on, so a change that fails leaves no trace in what is read. Reading joins
    versions by id: the latest row of each id that no later version names as gone. compact() writes one whole version.
    """

    spark: SparkSession
    root: str
    dim: int

    def _log(self) -> list[tuple[int, str, bool]]:
        """(number, version, whole) from the last whole version on."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_log")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = self.spark.read.schema("seq long, version string, whole boolean").json(f"{self.root}/_log").orderBy("seq").collect()
        first = max((k for k, r in enumerate(rows) if r["whole"]), default=0)
        return [tuple(r) for r in rows[first:]]

    def _read(self, version: str, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{version}/{name}")

    def migrate(self) -> None:
        """Empty tables where there are none."""
        if not self._log():
            self.clear()

    def _numbered(self, log: list[tuple[int, str, bool]]) -> tuple[DataFrame, DataFrame]:
        """Live rows of both tables with the number of their version."""
        every = lambda name, schema: reduce(DataFrame.unionByName, [self._read(v, name, schema).withColumn("_seq", F.lit(n)) for n, v, _ in log])
        documents, chunks = every("documents", STORED_DOCUMENT), every("chunks", STORED_CHUNK)
        if len(log) == 1:
            return documents, chunks
        gone = every("gone", "id string").groupBy("id").agg(F.max("_seq").alias("_gone"))
        last = documents.groupBy("id").agg(F.max("_seq").alias("_seq")).join(gone, "id", "left").where("_gone IS NULL OR _seq >= _gone").select("id", "_seq")
        return documents.join(last, ["id", "_seq"], "left_semi"), chunks.join(last.withColumnRenamed("id", "doc_id"), ["doc_id", "_seq"], "left_semi")

    def tables(self) -> tuple[DataFrame, DataFrame]:
        documents, chunks = self._numbered(self._log())
        return documents.select(*STORED_DOCUMENT.names), chunks.select(*STORED_CHUNK.names)

    def _write(self, documents: DataFrame, chunks: DataFrame, gone: DataFrame, whole: bool) -> None:
        """Chunks with a vector of another length fail the write."""
        version = uuid.uuid4().hex
        at = f"{self.root}/{version}"
        documents.select(*STORED_DOCUMENT.names).write.parquet(f"{at}/documents")
        checked = F.when(F.col("embedding").isNotNull(), V.checked(F.col("embedding"), self.dim)).alias("embedding")
        chunks.select(*[c for c in STORED_CHUNK.names if c != "embedding"], checked).select(*STORED_CHUNK.names).write.parquet(f"{at}/chunks")
        gone.select(F.col("id").cast("string").alias("id")).write.parquet(f"{at}/gone")
        log = self._log()
        seq = log[-1][0] + 1 if log else 0
        self.spark.createDataFrame([(seq, version, whole)], "seq long, version string, whole boolean").coalesce(1).write.mode("append").json(f"{self.root}/_log")

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "id string")

    def replace(self, documents: DataFrame, chunks: DataFrame) -> None:
        """Both tables, whole."""
        self._write(documents, chunks, self._none(), True)

    def change(self, documents: DataFrame | None = None, chunks: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Adds documents with their chunks, in place of those with the same ids, after the gone ones went."""
        if len(self._log()) >= COMPACT_AT:
            self.compact()
        empty = lambda schema: self.spark.createDataFrame([], schema)
        self._write(documents if documents is not None else empty(STORED_DOCUMENT), chunks if chunks is not None else empty(STORED_CHUNK), gone if gone is not None else self._none(), False)

    def add(self, documents: DataFrame, chunks: DataFrame) -> None:
        """As change; a document that is there keeps its created_at."""
        had = self.tables()[0].select("id", F.col("created_at").alias("_first"))
        kept = documents.join(had, "id", "left").withColumn("created_at", F.coalesce("_first", "created_at"))
        self.change(kept, chunks)

    def delete(self, source_uri: str) -> None:
        self.change(gone=self.tables()[0].where(F.col("source_uri") == source_uri).select("id"))

    def prune(self) -> None:
        self.change(gone=self.tables()[0].where(is_incomplete(F.col("hash"), F.col("metadata"))).select("id"))

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], STORED_DOCUMENT), self.spark.createDataFrame([], STORED_CHUNK))

    def compact(self) -> None:
        self.replace(*self.tables())

    def find_by_hash(self, value: str) -> DataFrame:
        return self.tables()[0].where(F.col("hash") == value)
