"""BM25 in Arrow batches: texts are cut and scored where they lie, and a task sends on its best rows of each query, not its matches.

Rows come as (id, text); ids don't repeat. What is scored is the text or, with a window (size, step), each window of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillstream.functions import text as X
from quillstream.runtime import cut, pieces

#: Bytes of text, and matches of a term with a query, that are worked on at once.
BYTES, PAIRS = 4 << 20, 1 << 20
FOLD = bytes.maketrans(X.UPPER.encode(), X.LOWER.encode())
#: X.SPACE, spelt out for RE2.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

Batches = Iterator[pa.RecordBatch]
Span = tuple[int, int] | None


@dataclass
class Counted:
    """Scored rows: (row, term, tf), by row and term, of the terms that the vocabulary has; each row's length, text and window."""

    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    length: np.ndarray
    text: np.ndarray
    ordinal: np.ndarray


def folded(texts: pa.StringArray) -> pa.StringArray:
    """Lower case of A to Z only, null as empty."""
    texts = pa.concat_arrays([texts.fill_null("")])  # from offset 0
    _, ends, data = texts.buffers()
    return pa.StringArray.from_buffers(len(texts), ends, pa.py_buffer((data.to_pybytes() if data else b"").translate(FOLD)))


def split(texts: pa.StringArray, pattern: str) -> tuple[np.ndarray, pa.StringArray]:
    """(text, part) of the parts that aren't empty."""
    lists = pc.split_pattern_regex(texts, pattern)
    parts = lists.flatten()
    some = pc.greater(pc.binary_length(parts), 0)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    return of[some.to_numpy(zero_copy_only=False)], parts.filter(some)


def places(parts: pa.StringArray, vocab: pa.StringArray) -> np.ndarray:
    return pc.index_in(parts, value_set=vocab).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def spread_out(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of many[i] each, one after the other."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if many.size else 0) + np.repeat(start - ends + many, many)


def counted(texts: pa.StringArray, vocab: pa.StringArray, window: Span) -> Counted:
    texts, most = folded(texts), max(len(vocab), 1)
    if window is None:
        row, terms = split(texts, X.TERM_BREAK)
        at = places(terms, vocab)
        key, tf = np.unique((row * most + at)[at >= 0], return_counts=True)
        n = len(texts)
        return Counted(key // most, key % most, tf, np.bincount(row, minlength=n), np.arange(n), np.zeros(n, np.int64))
    size, step = window
    doc, words = split(texts, SPACE)
    known = words.dictionary_encode()
    code = known.indices.to_numpy()
    # the distinct words' terms: how many each has, and which of them the vocabulary has
    owner, terms = split(known.dictionary, X.TERM_BREAK)
    at = places(terms, vocab)
    terms_of = np.bincount(owner, minlength=len(known.dictionary))
    start = np.searchsorted(owner[at >= 0], np.arange(len(known.dictionary) + 1))
    at = at[at >= 0]
    n = np.bincount(doc, minlength=len(texts))
    windows = np.where(n > size, -((size - n) // step), 0) + (n > 0)
    base = np.cumsum(windows) - windows
    j = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first, last = np.maximum((j - size + step) // step, 0), np.minimum(j // step, windows[doc] - 1)
    reps = last - first + 1
    row, code = spread_out(base[doc] + first, reps), np.repeat(code, reps)
    many = np.diff(start)[code]
    key, tf = np.unique(np.repeat(row, many) * most + at[spread_out(start[code], many)], return_counts=True)
    length = np.bincount(row, terms_of[code], int(windows.sum())).astype(np.int64)
    return Counted(key // most, key % most, tf, length, np.repeat(np.arange(len(texts)), windows), spread_out(np.zeros_like(windows), windows))


def rows_of(batches: Batches, vocab: pa.StringArray, window: Span) -> Iterator[tuple[pa.Array, Counted]]:
    """Ids and their counts, in pieces of bounded size."""
    for b in batches:
        for part in pieces(b, pc.binary_length(b.column(1)).fill_null(0).to_numpy(), BYTES):
            yield part.column(0), counted(part.column(1), vocab, window)


def count_documents(vocab: pa.StringArray, window: Span) -> Callable[[Batches], Batches]:
    """A task's (term, n): rows that have the term, by its place in the vocabulary; at -1 all rows, at -2 all their terms."""

    def run(batches: Batches) -> Batches:
        df, n, total = np.zeros(len(vocab), np.int64), 0, 0
        for _, c in rows_of(batches, vocab, window):
            df += np.bincount(c.term, minlength=len(vocab))
            n += c.length.size
            total += int(c.length.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int32()), pa.array([*df[at].tolist(), n, total], pa.int64())], ["term", "n"])

    return run


class Best:
    """The k best (score, id, ordinal) of each query; scores tie by the smaller id, null before others, and ordinal."""

    def __init__(self, k: int, queries: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[tuple] = []
        self.fresh: list[tuple] = []

    def add(self, scores: np.ndarray, matched: np.ndarray, ids: pa.Array, text: np.ndarray, ordinal: np.ndarray) -> None:
        """scores (row, query); only those matched count. A row's id is that of its text."""
        seen = np.where(matched, scores, -np.inf)
        n = len(seen)
        if n > self.k:  # no more than these and what ties with them can be among the best
            matched = matched & (seen >= np.partition(seen, n - self.k, axis=0)[n - self.k])
        row, query = np.nonzero(matched & (seen >= self.least))
        if not row.size:
            return
        names = ids.take(pa.array(text[row])).to_pylist()
        self.fresh += [(q, -s, i is not None, i, o) for q, s, i, o in zip(query.tolist(), scores[row, query].tolist(), names, ordinal[row].tolist())]
        if len(self.fresh) > max(2 * self.k * len(self.least), 4096) or not self.held:
            self.settle()

    def settle(self) -> list[tuple]:
        kept: list[tuple] = []
        last, n = -1, 0
        for x in sorted(self.held + self.fresh):
            last, n = x[0], n + 1 if x[0] == last else 1
            if n <= self.k:
                kept.append(x)
            if n == self.k:
                self.least[last] = -x[1]
        self.held, self.fresh = kept, []
        return kept


def best_rows(vocab: pa.StringArray, window: Span, idf: np.ndarray, avgdl: float, asked: list[tuple[int, int, int]], names: pa.Array, k: int, digits: int | None, k1: float, b: float, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """A task's k best rows of each query as (query, id, ordinal, score). asked: (term, query, times), by places; names: of the queries.

    With digits, rounded scores are ranked.
    """
    asked = sorted(asked)
    of, query, times = (np.array([x[j] for x in asked], np.int64) for j in range(3))
    start = np.searchsorted(of, np.arange(len(vocab) + 1))
    many, most = np.diff(start), len(names)

    def run(batches: Batches) -> Batches:
        best = Best(k, most)
        for ids, c in rows_of(batches, vocab, window):
            row, term = c.row, c.term
            w = idf[term] * c.tf * (k1 + 1) / (c.tf + k1 * (1 - b + b * c.length[row] / avgdl))
            pairs = np.bincount(row, many[term], c.length.size).astype(np.int64)
            for at, n in cut(np.maximum(pairs, most), PAIRS):
                lo, hi = np.searchsorted(row, (at, at + n))
                reps = many[term[lo:hi]]
                i = spread_out(start[term[lo:hi]], reps)
                cell = np.repeat((row[lo:hi] - at) * most, reps) + query[i]
                s = np.bincount(cell, np.repeat(w[lo:hi], reps) * times[i], n * most).reshape(n, most)
                best.add(s if digits is None else np.round(s, digits), s > 0, ids, c.text[at : at + n], c.ordinal[at : at + n])
        kept = best.settle()
        yield pa.RecordBatch.from_arrays([names.take(pa.array([x[0] for x in kept], pa.int64())), pa.array([x[3] for x in kept], schema.field("id").type), pa.array([x[4] for x in kept], pa.int64()), pa.array([-x[1] for x in kept], pa.float64())], schema=schema)

    return run
