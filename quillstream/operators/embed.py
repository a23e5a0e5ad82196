"""Embedders: the hashing trick offline, and a protocol for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillstream.functions import text as X
from quillstream.functions import vectors as V
from quillstream.operators import lexical
from quillstream.runtime import pieces, ship, spread, unique_ids

DIM = 1024
OFFSET, PRIME, WRAP = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


class Embedder(Protocol):
    """What a model must offer; made once per Python worker by a factory."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


def fnv1a(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & WRAP
    return h


def fnv1a_on(h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each state after the bytes data[start : start + size], a byte of all at a time: longest first, so those that go on are a prefix."""
    order = np.argsort(-size, kind="stable")
    h, start = h[order], start[order]
    left = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")  # longer than j bytes
    for j, n in enumerate(left.tolist()):
        h[:n] = (h[:n] ^ data[start[:n] + j]) * np.uint64(PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a_all(features: list[bytes]) -> np.ndarray:
    """fnv1a of each."""
    size = np.fromiter(map(len, features), np.int64, len(features))
    return fnv1a_on(np.full(size.size, OFFSET, np.uint64), np.frombuffer(b"".join(features), np.uint8), np.cumsum(size) - size, size)


class HashEmbedder:
    """Words and adjacent pairs, hashed to signed places, normalised."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        known: dict[bytes, int] = {}
        rows, which = [], []
        for k, t in enumerate(texts):
            words = [w.encode().lower() for w in t.split()]
            found = [known.setdefault(f, len(known)) for f in (*words, *map(b"_".join, zip(words, words[1:])))]
            rows.append(np.full(len(found), k))
            which.append(np.array(found, np.int64))
        h = fnv1a_all(list(known))
        at = (h % np.uint64(self.dim)).astype(np.int64)
        sign = np.where(h >> np.uint64(63), -1.0, 1.0)
        row, f = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*which, np.zeros(0, np.int64)])
        out = np.bincount(row * self.dim + at[f], sign[f], len(texts) * self.dim).reshape(len(texts), self.dim)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


class OnnxEmbedder:
    """Mean-pooled, normalised sentence embeddings of an ONNX model with a tokenizer file; both given by path."""

    def __init__(self, model: str, tokenizer: str, max_tokens: int = 512):
        import onnxruntime
        from tokenizers import Tokenizer

        self.session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenizer.enable_truncation(max_tokens)
        self.tokenizer.enable_padding()
        self.dim = int(self.session.get_outputs()[0].shape[-1])

    def embed(self, texts: list[str]) -> np.ndarray:
        coded = self.tokenizer.encode_batch(texts)
        mask = np.array([c.attention_mask for c in coded], np.int64)
        names = {i.name for i in self.session.get_inputs()}
        feed = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        hidden = self.session.run(None, {k: v for k, v in feed.items() if k in names})[0]
        mean = (hidden * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        n = np.linalg.norm(mean, axis=1, keepdims=True)
        return mean / np.where(n == 0, 1, n)


def embed_column(df: DataFrame, make: Callable[[], Embedder], *, text_col: str = "text", out_col: str = "embedding", batch: int = 64) -> DataFrame:
    """df with an array<float> column; a model is made once a task and fed batches of texts."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            parts = [model.embed(texts[i : i + batch]).astype(np.float32) for i in range(0, len(texts), batch)]
            flat = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(flat.shape[0] + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, out_col])

    return spread(df).mapInArrow(run, schema)


def _features(batches: Iterator[pa.RecordBatch], dim: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in pieces(b, pc.binary_length(b.column(1)).fill_null(0).to_numpy() + 8 * dim, lexical.BYTES):
            n = part.num_rows
            doc, words = lexical.split(lexical.folded(part.column(1)), lexical.SPACE)
            words = pa.concat_arrays([words])  # from offset 0
            _, ends, raw = words.buffers()
            ends = np.frombuffer(ends, np.int32)[: len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
            data = np.frombuffer(raw, np.uint8) if len(words) else np.zeros(0, np.uint8)
            start, size = ends[:-1], np.diff(ends)
            one = fnv1a_on(np.full(len(words), OFFSET, np.uint64), data, start, size)
            next_to = np.flatnonzero(doc[1:] == doc[:-1])
            two = fnv1a_on((one[next_to] ^ np.uint64(ord("_"))) * np.uint64(PRIME), data, start[next_to + 1], size[next_to + 1])
            h, row = np.concatenate([one, two]), np.concatenate([doc, doc[next_to]])
            at = row * dim + (h % np.uint64(dim)).astype(np.int64)
            v = np.bincount(at, np.where(h >> np.uint64(63), -1.0, 1.0), n * dim)
            norm = np.sqrt((v * v).reshape(n, dim).sum(1))
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some // dim)), pa.array(some % dim), pa.array(v[some] / norm[some // dim])], schema=schema)


def hash_features(docs: DataFrame, dim: int = DIM, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The hash embedding as sparse rows (doc_id, idx, value); zero sums don't show.

    A row's features are hashed and summed where it lies. Rows of one id count as one text's, so where ids repeat they meet
    first, in built-in functions: distinct features are hashed once there, and their places joined back.
    """
    if unique_ids(docs, id_col):
        ship(docs.sparkSession)
        rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        out = T.StructType([rows.schema["doc_id"], T.StructField("idx", T.LongType()), T.StructField("value", T.DoubleType())])
        return rows.mapInArrow(lambda batches: _features(batches, dim, to_arrow_schema(out)), out)
    w = docs.select(F.col(id_col).alias("doc_id"), F.transform(X.words(F.col(text_col)), X.fold).alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    counted = w.select("doc_id", F.explode(F.concat("w", pairs)).alias("f")).groupBy("doc_id", "f").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.select("f").distinct().withColumn("h", V.fnv1a(F.col("f"))).select("f", V.hash_index(F.col("h"), dim).alias("idx"), V.hash_sign(F.col("h")).alias("sign"))
    sums = counted.join(placed, "f").groupBy("doc_id", "idx").agg(F.sum(F.col("n") * F.col("sign")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))  # a missing id counts as one
    return sums.withColumn("norm", norm).where("v != 0").select("doc_id", "idx", (F.col("v") / F.col("norm")).alias("value"))
