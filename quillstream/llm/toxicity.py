"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled rows: one of ordinary text (its most frequent words), one of toxic text
(the same, and the strings that toxic rows have far oftener than ordinary ones). A text is cut into windows of WINDOW
words; a window's distance is how many bytes fewer it takes with the toxic dictionary. The number of windows whose
distance passes a threshold, and the sum of distances, are turned into a score by a logistic model; the threshold is the
one that fits the labels best.

zstandard doesn't look for matches in a block's last bytes and stores a block plain if it gains next to nothing, so each
window is followed by a constant tail that both dictionaries hold.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.runtime import ship

#: At most so many labelled rows of each class are learned from, chosen by a hash of their ids, none longer than ROW_BYTES.
TOXIC_ROWS, ORDINARY_ROWS, ROW_BYTES = 1_500, 3_000, 16 << 10
HELD_OUT, HELD_OUT_REST, CUT = 4, 2, 0.3
WINDOW, SHORTEST, LONGEST, PER_ROW = 6, 6, 10, 6
COMMON, TOXIC_BYTES, LEAST_SHARE, RATIO = 300, 600, 0.1, 3
TAIL, GAP = bytes(range(128, 192)), b"\0"


def held_out(doc_id: int | None) -> bool:
    """A null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == HELD_OUT_REST


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def strings(word: bytes) -> list[bytes]:
    """Strings of SHORTEST to LONGEST bytes inside a word, the spaces around it included; those that repeat, repeatedly."""
    w = b" " + word + b" "
    return [w[i : i + k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1) for i in range(len(w) - k + 1)]


def rates(rows: list[str], known: dict[bytes, int], add: bool) -> np.ndarray:
    """Mean number of each known string in a row, PER_ROW times at most and damped by the row's length. add: learn strings."""
    inside: dict[bytes, np.ndarray] = {}
    out = np.zeros(1 << 16)
    for words in map(words_of, rows):
        counts = Counter(words)
        for w in counts:
            if w not in inside:
                inside[w] = np.array([known.setdefault(g, len(known)) for g in strings(w)] if add else [known[g] for g in strings(w) if g in known], np.int64)
        which = [inside[w] for w in counts]
        if not which:
            continue
        at, back = np.unique(np.concatenate(which), return_inverse=True)
        times = np.bincount(back, np.repeat(list(counts.values()), [x.size for x in which]), at.size)
        while out.size < len(known):
            out = np.append(out, np.zeros(out.size))
        out[at] += np.minimum(times, PER_ROW) / math.sqrt(len(words) + 20) / len(rows)
    return np.resize(out, len(known)) if out.size >= len(known) else np.append(out, np.zeros(len(known) - out.size))


def distinctive(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Strings that toxic rows have far oftener, the best first; none within another."""
    known: dict[bytes, int] = {}
    p = rates(toxic, known, True)
    q = rates(ordinary, known, False)
    names = list(known)
    size = np.array([len(g) for g in names], np.float64)
    score = (p - q) / np.sqrt((p + q) / 2 + 0.01) * np.log((p + 1e-3) / (q + 1e-3)) * np.sqrt(size)
    some = np.flatnonzero((p > RATIO * q) & (score >= LEAST_SHARE * score.max(initial=0, where=p > RATIO * q)))
    out: list[bytes] = []
    for _, g in sorted((-float(score[i]), names[i]) for i in some.tolist()):
        if sum(map(len, out)) > TOXIC_BYTES:
            break
        if not any(o in g or g in o for o in out):
            out.append(g)
    return out


@dataclass
class Model:
    """What executors get: two dictionaries, a threshold, and the weights of the logistic model; all of fixed size."""

    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: np.ndarray
    constant: float | None = None

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}

    def distances(self, words: list[bytes]) -> np.ndarray:
        """Of each window; a text without words has one empty window."""
        if self._pair is None:
            import zstandard as zs

            kind = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_LAZY2, min_match=6, window_log=12, hash_log=12, chain_log=12, search_log=4, write_content_size=False, write_dict_id=False, write_checksum=False)
            self._pair = [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=kind).compress for d in (self.ordinary, self.toxic)]
        plain, bad = self._pair
        windows = [b" " + b" ".join(words[i : i + WINDOW]) + b" " + TAIL for i in range(0, max(1, len(words)), WINDOW)]
        return np.array([len(plain(w)) - len(bad(w)) for w in windows])

    def score(self, words: list[bytes]) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(features(self.distances(words), self.threshold) @ self.weights, -40, 40))))


def features(d: np.ndarray, threshold: int) -> np.ndarray:
    n, hits, total = d.size, int((d >= threshold).sum()), int(np.maximum(d, 0).sum())
    return np.array([1.0, math.log((hits + 0.1) / (n + 2)), hits / (n + 1), math.log(n + 1), float(hits > 0), math.log((total + 0.3) / (n + 2))])


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """The model of two classes of texts; without texts of a class, a constant."""
    if not toxic or not ordinary:
        return Model(b"", b"", 1, np.zeros(6), 1.0 if toxic else 0.0)
    common = Counter(w for t in ordinary for w in words_of(t))
    shared = GAP.join(b" " + w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:COMMON][::-1]) + GAP + TAIL
    model = Model(GAP.join(distinctive(toxic, ordinary)) + GAP + shared, shared, 1, np.zeros(6))
    found = [model.distances(words_of(t)) for t in (*toxic, *ordinary)]
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    best = math.inf
    for threshold in range(1, 7):
        x = np.array([features(d, threshold) for d in found])
        scale = np.append(1.0, x[:, 1:].std(0) + 1e-9)
        z, w = x / scale, np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            w += np.linalg.solve((z.T * (p * (1 - p))) @ z + 1e-2 * np.eye(w.size), z.T @ (y - p) - 1e-2 * w)
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        # every class counts as in the table, so scores stay probabilities of the sample's mix
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if loss < best:
            best, model.threshold, model.weights = loss, threshold, w / scale
    return model


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """From labelled rows outside the held-out part. Ids with several labels count as toxic if one says so.

    What comes to the driver is TOXIC_ROWS + ORDINARY_ROWS texts of ROW_BYTES at most, however often an id repeats. Null
    texts count as empty; labels with a null id or value aren't used; without rows of a class every score is a constant.
    """
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    told = told.where(F.crc32(F.col("i").cast("string").cast("binary")) % HELD_OUT != HELD_OUT_REST).withColumn("o", F.xxhash64("i"))
    share = told.agg(F.sum((F.col("y") == 1).cast("long")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    toxic_rows = TOXIC_ROWS
    ordinary_rows = ORDINARY_ROWS
    if share["a"] and share["n"] > share["a"]:  # the sample keeps the classes' proportion, as far as the bounds go
        toxic_rows = max(min(TOXIC_ROWS, share["a"]), 1)
        ordinary_rows = max(1, min(ORDINARY_ROWS, share["n"] - share["a"]))
        toxic_rows = min(toxic_rows, max(50, round(ordinary_rows * share["a"] / (share["n"] - share["a"]))))
    ids = told.where("y = 1").orderBy("o", "i").limit(toxic_rows).unionByName(told.where("y = 0").orderBy("o", "i").limit(ordinary_rows))
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.octet_length("t") <= ROW_BYTES)
    rows = texts.join(F.broadcast(ids), "i").select("y", "t", "o", "i").orderBy("o", "i", "t").limit(TOXIC_ROWS + ORDINARY_ROWS).toPandas()
    return fit(rows.loc[rows["y"] == 1, "t"].tolist(), rows.loc[rows["y"] == 0, "t"].tolist())


RESULT = "doc_id long, held_out boolean, score double, predicted int"


def score_rows(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null texts count as empty and are scored like a text without words; a text of any length is scored whole; repeated rows
    come out repeated; other columns don't matter. An empty table gives an empty result.
    """
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            s = np.array([m.score(words_of(t.as_py())) for t in b.column(1)])
            held = [held_out(i) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def keep_ordinary(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't call toxic, columns unchanged, whatever their names.

    Null and empty texts are scored as in score_rows, and come out as they were; repeated rows stay or go together; an empty
    table stays empty.
    """
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            at = b.schema.get_field_index(text_col)
            yield b.filter(pa.array([m.score(words_of(t.as_py())) < CUT for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
