"""Language-model scoring with a log-bilinear model, beside an add-0.1 unigram base.

The neural model predicts a token from the one before: the context's vector is matched with each target's. Every word of the
training part has a vector as a target and one as a context, so the model grows with the corpus. The WORDS most frequent
words, one class for all others and a text's end make the core. Its training data are the dense pair counts of the whole
training part, from which noise-contrastive estimation takes its positives; both its sides are learned together.

A word outside the core has its vectors learned next, in the range of hashes it belongs to, from all its own pairs and noise
against the core, whose vectors stay: as a context from the class of each next token, as a target from the class of each
token before. A prior draws them to the class's own vectors, so what is seen once moves little. The neighbour counts in such
a pair by its class. Words with the same pairs share vectors.

P(word | context) is P(class | context), normalised over the core's targets, times P(word | class of others, class of the
context), normalised over all words outside the core and an unseen one. Both normalisers are exact: the first comes with a
context's vector, the second is summed over the ranges. So probabilities of seen words sum to one with the base's allowance
for an unseen one.

Words outside the core meet their vectors by range of hash: none of them can have more than one in WORDS of the tokens. One
pass over the texts sends their occurrences there, held-out rows' apart; the vectors are learned from the training rows' and
then meet both where they are.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.runtime import checkpointed, ship

ADD, WORDS, HELD_OUT = 0.1, 512, 10
DIM, NOISE, STEPS, RATE, SEED = 24, 25, 200, 0.05, 10
PRIOR, FIT_STEPS, FIT_BLOCK = 1.0, 12, 1024
SETTLED = 1e-3  # nats that a step still changes a word's objective by
PARTITION = 24 << 20  # text bytes a partition
ROW_BLOCK = 1024

COUNTS, TOTAL, KINDS, TOP, RARE, ASKED, TEXTS, SUMS, VECTORS, SHARES = range(10)  # kinds of rows; RARE: to learn from, ASKED: held out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(doc_id: int | None) -> bool:
    """A null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


def _part(word: bytes, parts: int) -> int:
    return zlib.crc32(word) % parts


# Messages: counts and words.


def pack_counts(words: list[bytes], counts: list[int]) -> bytes:
    return struct.pack("<i", len(words)) + np.array(counts, np.int64).tobytes() + b" ".join(words)


def unpack_counts(data: bytes) -> tuple[list[bytes], np.ndarray]:
    (n,) = struct.unpack_from("<i", data)
    return data[4 + 8 * n :].split(b" ") if n else [], np.frombuffer(data, np.int64, n, 4)


ROWS_SQL = "part int, kind int, payload binary, word binary, n long"


def _rows(rows: list[tuple[int, int, bytes | None, bytes | None, int | None]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["part", "kind", "payload", "word", "n"])


def count_words(parts: int):
    """(doc_id, text) of training rows to word counts by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[bytes] = Counter()
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                if not held_out(i):
                    found.update(words_of(t.as_py()))
            dealt: dict[int, tuple[list[bytes], list[int]]] = defaultdict(lambda: ([], []))
            for w, n in found.items():
                ws, ns = dealt[_part(w, parts)]
                ws.append(w)
                ns.append(n)
            yield _rows([(p, COUNTS, pack_counts(*x), None, None) for p, x in dealt.items()])

    return run


def merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's sums and its most frequent words."""
    found: dict[bytes, int] = {}
    part = None
    for b in batches:
        for p, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            part = p
            ws, ns = unpack_counts(data)
            for w, n in zip(ws, ns.tolist()):
                found[w] = found.get(w, 0) + n
    if part is None:
        return
    yield _rows([(part, TOTAL, None, None, sum(found.values())), (part, KINDS, None, None, len(found))])
    top = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:WORDS]
    yield _rows([(part, TOP, None, w, n) for w, n in top])


def token_ids(words: list[bytes], vocabulary: dict[bytes, int], other: int) -> np.ndarray:
    """A text's tokens and its end."""
    out = np.empty(len(words) + 1, np.int64)
    out[:-1] = np.fromiter(map(vocabulary.get, words, repeat(other)), np.int64, len(words))
    out[-1] = other + 1
    return out


def neighbours(ids: np.ndarray, other: int) -> np.ndarray:
    """The token before each, or the start."""
    before = np.empty_like(ids)
    before[0], before[1:] = other + 2, ids[:-1]
    return before


class RareWords:
    """The words outside the core in a batch, with the row and the neighbours' classes of each occurrence."""

    def __init__(self, other: int):
        self.other = other
        self.kind = np.uint16 if other + 3 <= 65536 else np.uint32
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.found: list[np.ndarray] = []

    def add(self, row: int, words: list[bytes], ids: np.ndarray, before: np.ndarray) -> None:
        at = np.flatnonzero(ids == self.other)
        if at.size:
            which = np.fromiter(map(self.words.__getitem__, map(words.__getitem__, at.tolist())), np.uint32, at.size)
            self.found.append((which, np.full(at.size, row, np.uint32), before[at].astype(self.kind), ids[at + 1].astype(self.kind)))

    def messages(self, parts: int, first: int, rows: int, kind: int) -> list[tuple]:
        if not self.found:
            return []
        words = list(self.words)
        wid, row, prev, following = (np.concatenate(c) for c in zip(*self.found))
        self.found.clear()
        dealt = np.array([_part(w, parts) for w in words])
        turn = np.argsort(dealt, kind="stable")  # words by part
        rank = np.empty(turn.size, np.uint64)
        rank[turn] = np.arange(turn.size, dtype=np.uint64)
        both = rank[wid] << np.uint64(32)
        both |= np.arange(wid.size, dtype=np.uint64)
        both.sort()  # rows come in order
        order = both.astype(np.uint32)
        both >>= np.uint64(32)
        rank = both.astype(np.int64)
        size = np.uint16 if max(rows, self.other + 3) <= 65536 else np.uint32
        row, prev, following = (x.astype(size)[order] for x in (row, prev, following))
        new = np.flatnonzero(np.diff(rank, prepend=-1))  # each word occurs
        times = np.diff(np.append(new, rank.size)).astype(np.uint32)
        lows = np.append(0, np.flatnonzero(np.diff(dealt[turn])) + 1).tolist()
        order = turn.tolist()
        out = []
        for lo, hi in zip(lows, [*lows[1:], turn.size]):
            a, b = int(new[lo]), int(new[hi]) if hi < turn.size else rank.size
            head = struct.pack("<qiiiB", first, rows, hi - lo, b - a, np.dtype(size).itemsize)
            out.append((int(dealt[order[lo]]), kind, b"".join([head, times[lo:hi].tobytes(), *[x[a:b].tobytes() for x in (row, prev, following)], b" ".join([words[i] for i in order[lo:hi]])]), None, None))
        return out


def unpack_rare(data: bytes) -> tuple[int, int, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First uid, number of rows, words, times of each; row, class before and class after of each occurrence."""
    first, rows, n_words, n, size = struct.unpack_from("<qiiiB", data)
    at = struct.calcsize("<qiiiB")
    times = np.frombuffer(data, np.uint32, n_words, at)
    at += 4 * n_words
    columns = []
    for _ in range(3):
        columns.append(np.frombuffer(data, {2: np.uint16, 4: np.uint32}[size], n, at))
        at += size * n
    return first, rows, data[at:].split(b" "), times, *columns


def count_pairs(vocabulary: dict[bytes, int]):
    """Training rows to counts of (context, target) cells, one set a task."""
    other = len(vocabulary)
    wide = other + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((other + 3) * wide, np.int64)
        for b in batches:
            got = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                if not held_out(i):
                    ids = token_ids(words_of(t.as_py()), vocabulary, other)
                    got.append(neighbours(ids, other) * wide + ids)
            if got:
                total += np.bincount(np.concatenate(got), minlength=total.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return run


def smoothed(pairs: np.ndarray) -> np.ndarray:
    unigram = pairs.sum(0) + 1.0
    return unigram / unigram.sum()


def learn_core(pairs: np.ndarray, seed: int = SEED, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair counts (contexts x targets) to context vectors (through the matrix), target vectors and biases.

    Noise-contrastive estimation: a pair's score less the log of its expected noise is the logit that it is no noise.
    Pairs and noise enter with their expected numbers (counts, and NOISE times a context's count by the smoothed unigram
    distribution), so a step is a few matrix products over all cells and nothing is drawn but the start.
    """
    contexts, targets = pairs.shape
    rng = np.random.default_rng(seed)
    unigram = smoothed(pairs)
    params = [rng.normal(0, 0.1, (contexts, DIM)), np.eye(DIM), rng.normal(0, 0.1, (targets, DIM)), np.log(unigram)]
    total = pairs.sum()
    if total:
        real = pairs / total
        noise = NOISE * real.sum(1, keepdims=True) * unigram
        shift = np.log(NOISE * unigram)
        mean, spread = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
        for k in range(1, steps + 1):
            r, c, q, bias = params
            hidden = r @ c
            taken = 1 / (1 + np.exp(shift - bias - hidden @ q.T))
            g = real * (1 - taken) - noise * taken
            back = g @ q
            for x, m, v, d in zip(params, mean, spread, (back @ c.T, r.T @ back, g.T @ hidden, g.sum(0))):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                x += RATE * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
    r, c, q, bias = params
    return r @ c, q, bias


def log_normaliser(z: np.ndarray) -> np.ndarray:
    most = z.max(1)
    return most + np.log(np.exp(z - most[:, None]).sum(1))


def train(pairs: np.ndarray, seed: int = SEED, steps: int = STEPS) -> np.ndarray:
    """Pair counts (contexts x targets) to natural log probabilities of the same shape, each row normalised."""
    hidden, q, bias = learn_core(pairs, seed, steps)
    z = hidden @ q.T + bias
    return z - log_normaliser(z)[:, None]


def fit(word: np.ndarray, cls: np.ndarray, n: np.ndarray, core: np.ndarray, offset: np.ndarray, noise: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Vectors of words 0, 1, ... from their positives (word ascending, core class, count) by noise-contrastive estimation.

    core @ vector + offset is the logit that a pair is no noise. noise: expected noise pairs by class for each positive. The
    objective is concave; steps are scaled by its curvature at the prior's mean, and shortened where they don't raise it.
    """
    # in the axes of the noise's curvature; single precision, as the vectors are kept
    taken = 1 / (1 + np.exp(-(core @ mean + offset)))
    curve, axes = np.linalg.eigh((core * (noise * taken * (1 - taken))[:, None]).T @ core)
    core, mean, curve, offset, noise = (x.astype(np.float32) for x in (core @ axes, mean @ axes, np.maximum(curve, 0), offset, noise))
    across = np.ascontiguousarray(core.T)
    words = int(word[-1]) + 1
    start = np.searchsorted(word, np.arange(words + 1))
    out = np.tile(mean, (words, 1))

    def look(at: np.ndarray, total: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The objective of words at vectors v, and its slope."""
        size = start[at + 1] - start[at]
        first = np.cumsum(size) - size
        pos = np.repeat(start[at] - first, size) + np.arange(size.sum())
        m, near = n[pos].astype(np.float32), core[cls[pos]]
        odds = np.exp(np.minimum((near * np.repeat(v, size, axis=0)).sum(1) + offset[cls[pos]], 80))
        value = np.add.reduceat(m * np.log(odds / (1 + odds)), first)
        slope = np.add.reduceat((m / (1 + odds))[:, None] * near, first)
        z = v @ across
        z += offset
        np.exp(np.minimum(z, 80, out=z), out=z)
        odds = z + 1
        np.divide(z, odds, out=z)
        z *= noise
        np.log(odds, out=odds)
        off = v - mean
        return value - total[:, 0] * (odds @ noise) - PRIOR / 2 * (off * off).sum(1), slope - total * (z @ core) - PRIOR * off

    for a in range(0, words, FIT_BLOCK):
        at = np.arange(a, min(a + FIT_BLOCK, words))
        total = np.add.reduceat(n[start[a] : start[at[-1] + 1]], start[at] - start[a]).astype(np.float32)[:, None]
        v, rate = out[at], np.ones((at.size, 1), np.float32)
        value, slope = look(at, total, v)
        for _ in range(FIT_STEPS):
            new = v + rate * slope / (PRIOR + total * curve)
            f, g = look(at, total, new)
            gain = f - value
            better = gain > 0
            v[better], value[better], slope[better] = new[better], f[better], g[better]
            rate[~better] /= 4
            out[at] = v
            going = np.abs(gain) > SETTLED
            if not going.any():
                break
            at, total, v, rate, value, slope = at[going], total[going], v[going], rate[going], value[going], slope[going]
    return out @ axes.T


def alike(word: np.ndarray, cls: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each word's set of pairs, by number, and the sets."""
    start = np.searchsorted(word, np.arange(words + 1))
    rows = np.stack([cls, n], axis=1).astype(np.int64)
    known: dict[bytes, int] = {}
    index, first = np.empty(words, np.int32), []
    for w, (a, b) in enumerate(zip(start[:-1].tolist(), start[1:].tolist())):
        k = index[w] = known.setdefault(rows[a:b].tobytes(), len(known))
        if k == len(first):
            first.append(np.arange(a, b))
    at = np.concatenate(first)
    return index, (np.repeat(np.arange(len(first)), [x.size for x in first]), cls[at], n[at])


def sparse(word: np.ndarray, cls: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell, n = np.unique(word * wide + cls, return_counts=True)
    return cell // wide, cell % wide, n


def learn_rare(core: tuple[np.ndarray, np.ndarray, np.ndarray], pairs: np.ndarray, rare_mass: float):
    """Messages of a part's words outside the core to their counts and vectors (VECTORS), and what they add to the
    normaliser of the class of others after each context (SHARES). All messages pass, vectors last.

    rare_mass: what the smoothed counts of all words outside the core sum to.
    """
    hidden, q, bias = core
    contexts, targets = pairs.shape
    other = targets - 2
    unigram = smoothed(pairs)
    before = pairs[:, other] / max(pairs[:, other].sum(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: defaultdict[bytes, int] = defaultdict()
        found.default_factory = found.__len__
        me, got = None, []
        for b in batches:
            yield b
            for p, kind, data in zip(*(b.column(k).to_pylist() for k in (0, 1, 2))):
                if kind != RARE:
                    continue
                me = p
                _, _, words, times, _, prev, following = unpack_rare(data)
                got.append((np.repeat(np.array([found[w] for w in words], np.int32), times), prev, following))
        if me is None:
            return
        word, prev, following = (np.concatenate(c).astype(np.int64) for c in zip(*got))
        got.clear()
        words = sorted(found)
        turn = np.empty(len(words), np.int64)
        turn[[found[w] for w in words]] = np.arange(len(words))
        word = turn[word]
        counts = np.bincount(word)
        as_target, sets = alike(*sparse(word, prev, contexts), len(words))
        q_rare = fit(*sets, hidden, np.full(contexts, -np.log(NOISE)), NOISE * before, np.zeros(DIM)).astype(np.float32)
        as_context, sets = alike(*sparse(word, following, targets), len(words))
        h_rare = fit(*sets, q, bias - np.log(NOISE * unigram), NOISE * unigram, hidden[other]).astype(np.float32)
        norm = np.concatenate([log_normaliser(h_rare[a : a + FIT_BLOCK].astype(np.float64) @ q.T + bias) for a in range(0, len(h_rare), FIT_BLOCK)])
        mass = np.bincount(as_target, (counts + ADD) / rare_mass, len(q_rare))
        shares = sum(mass[a : a + FIT_BLOCK] @ np.exp(q_rare[a : a + FIT_BLOCK].astype(np.float64) @ hidden.T) for a in range(0, len(q_rare), FIT_BLOCK))
        data = io.BytesIO()
        np.savez(data, counts=counts, as_target=as_target, q=q_rare, as_context=as_context, h=h_rare, norm=norm, words=np.frombuffer(b" ".join(words), np.uint8))
        yield _rows([(me, VECTORS, data.getvalue(), None, None), (me, SHARES, shares.tobytes(), None, None)])

    return run


def _row_part(uid: int, parts: int) -> int:
    return ((uid >> 33) * 977 + ((uid & ((1 << 33) - 1)) // ROW_BLOCK)) % parts


def score_texts(vocabulary: dict[bytes, int], base_in: np.ndarray, log_p: np.ndarray, ends: bool, parts: int):
    """(uid, doc_id, text) to sums of the tokens in the vocabulary (TEXTS) and rare words by part (RARE and ASKED).

    base_in: log10(c + ADD) of the vocabulary's words, 0, and of the end. log_p: of a class after a class. uids count up by
    one in a partition.
    """
    other = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            uid = b.column(0).to_numpy()
            own = b.column(1).to_pylist()
            held = np.array([held_out(o) for o in own])
            rare = RareWords(other), RareWords(other)
            sums = np.zeros((4, b.num_rows))  # tokens, known in the vocabulary, base, model
            for k, t in enumerate(b.column(2)):
                words = words_of(t.as_py())
                ids = token_ids(words, vocabulary, other)
                before = neighbours(ids, other)
                inside = ids < other
                sums[:, k] = ids.size, np.count_nonzero(inside) + ends, base_in[ids].sum(), log_p[before, ids].sum()
                rare[int(held[k])].add(k, words, ids, before)
            rows = []
            kept = [o is not None for o in own]
            ids = np.array([o or 0 for o in own], np.int64)
            block = np.array([_row_part(u, parts) for u in uid.tolist()])
            for part in np.unique(block).tolist():
                at = np.flatnonzero(block == part)
                rows.append((part, TEXTS, struct.pack("<i", at.size) + uid[at].tobytes() + ids[at].tobytes() + sums[:, at].tobytes() + (np.array(kept)[at] + 2 * held[at]).astype(np.uint8).tobytes(), None, None))
            for r, kind in zip(rare, (RARE, ASKED)):
                rows += r.messages(parts, int(uid[0]), b.num_rows, kind)
            yield _rows(rows)

    return run


def meet_vectors(parts: int, core: tuple[np.ndarray, np.ndarray, np.ndarray], log_shares: np.ndarray):
    """Vectors and words outside the core of a part to sums by row, dealt by row; TEXTS pass.

    log_shares: the log normaliser, after each class, of the words in the class of others.
    """
    hidden, q, bias = core
    other = len(bias) - 2
    usual = hidden[other] @ q.T + bias
    usual = usual - log_normaliser(usual[None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[bytes, int] = {}
        waiting: list[bytes] = []
        me = None
        for b in batches:
            passed = []
            for p, kind, data in zip(*(b.column(k).to_pylist() for k in (0, 1, 2))):
                if kind == VECTORS:
                    z = np.load(io.BytesIO(data))
                    counts, as_target, q_rare, as_context, h_rare, norm = (z[k] for k in ("counts", "as_target", "q", "as_context", "h", "norm"))
                    at = {w: i for i, w in enumerate(z["words"].tobytes().split(b" "))}
                elif kind in (RARE, ASKED):
                    waiting.append(data)
                    me = p
                elif kind == TEXTS:
                    passed.append((p, kind, data, None, None))
            yield _rows(passed)
        for data in waiting:
            first, rows, words, times, doc, prev, following = unpack_rare(data)
            own = np.repeat(np.array([at.get(w, -1) for w in words]), times)
            seen = own >= 0
            base, extra = np.full(own.size, np.log10(ADD)), -log_shares[prev]
            if seen.any():
                i, k, t = own[seen], prev[seen], following[seen]
                base[seen] = np.log10(counts[i] + ADD)
                c = as_context[i]
                extra[seen] += np.einsum("ij,ij->i", hidden[k], q_rare[as_target[i]]) + np.einsum("ij,ij->i", h_rare[c], q[t]) + bias[t] - norm[c] - usual[t]
            base, known, rare, extra = (np.bincount(doc, x, rows) for x in (base, seen, np.ones(own.size), extra / np.log(10)))
            some = np.flatnonzero(rare)
            uid = first + some
            block = np.array([_row_part(u, parts) for u in uid.tolist()])
            out = []
            for part in np.unique(block).tolist():
                x = some[block == part]
                out.append((part, SUMS, struct.pack("<ii", me, x.size) + (first + x).tobytes() + base[x].tobytes() + extra[x].tobytes() + known[x].astype(np.float32).tobytes() + rare[x].astype(np.float32).tobytes(), None, None))
            yield _rows(out)

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def add_up(total: int, log_all: float, log_rare: float):
    """A range of rows: what the vocabulary and each part of the rare words gave. Sums go in the order of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, parts = [], []
        for b in batches:
            for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if kind == TEXTS:
                    (n,) = struct.unpack_from("<i", data)
                    texts.append((np.frombuffer(data, np.int64, n, 4), np.frombuffer(data, np.int64, n, 4 + 8 * n), np.frombuffer(data, np.float64, 4 * n, 4 + 16 * n).reshape(4, n), np.frombuffer(data, np.uint8, n, 4 + 48 * n)))
                else:
                    me, n = struct.unpack_from("<ii", data)
                    parts.append((np.frombuffer(data, np.int64, n, 8), np.full(n, me), np.frombuffer(data, np.float64, n, 8 + 8 * n), np.frombuffer(data, np.float64, n, 8 + 16 * n), np.frombuffer(data, np.float32, n, 8 + 24 * n), np.frombuffer(data, np.float32, n, 8 + 28 * n)))
        if not texts:
            return
        uid, own, flags = (np.concatenate([t[k] for t in texts]) for k in (0, 1, 3))
        tokens, known, base, model = np.concatenate([t[2] for t in texts], axis=1)
        order = np.argsort(uid)
        if parts:
            u, me, more, extra, seen, rare = (np.concatenate([p[k] for p in parts]) for k in range(6))
            turn = np.lexsort((me, u))
            row = order[np.searchsorted(uid[order], u[turn])]
            more, extra = np.bincount(row, more[turn], uid.size), np.bincount(row, extra[turn], uid.size)
            known = known + np.bincount(row, seen[turn].astype(np.float64), uid.size)
            rare = np.bincount(row, rare[turn].astype(np.float64), uid.size)
        else:
            more = extra = rare = np.zeros(uid.size)
        whole = lambda x: pa.array(np.rint(x).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, mask=flags & 1 == 0), pa.array(flags & 2 > 0), whole(tokens), whole(known), pa.array(np.full(uid.size, total)), pa.array(base + more - tokens * log_all), pa.array(model + more + extra - rare * log_rare)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per row of docs: columns of RESULT.

    Rows whose id's crc32 (of its decimal text; a null id as the empty text) is no multiple of HELD_OUT are learned from.
    Null texts count as empty, and have the end as their only token. Repeated rows count one by one. Without training rows
    all counts are zero. An empty table gives an empty result. parts: partitions between the steps, as in suffix_dedup.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION + 1)
    dealt = lambda df: df.repartitionById(parts, F.col("part"))

    counted = checkpointed(dealt(texts.mapInArrow(count_words(parts), ROWS_SQL)).mapInArrow(merge_counts, ROWS_SQL))
    sums = {r["kind"]: r["n"] for r in counted.where(F.col("kind").isin(TOTAL, KINDS)).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    top = [(bytes(r["word"]), r["n"]) for r in counted.where(F.col("kind") == TOP).orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    vocabulary = {w: k for k, (w, _) in enumerate(top)}

    shape = (len(top) + 3, len(top) + 2)
    cells = texts.mapInArrow(count_pairs(vocabulary), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(shape[0] * shape[1])
    pairs[cells["cell"].to_numpy(np.int64)] = cells["n"]
    pairs = pairs.reshape(shape)
    ends = int(pairs[:, -1].sum())
    tokens, kinds = sums.get(TOTAL, 0) + ends, sums.get(KINDS, 0) + (ends > 0)
    core = learn_core(pairs)
    z = core[0] @ core[1].T + core[2]
    log_p = z - log_normaliser(z)[:, None]
    base_in = np.concatenate([np.log10(np.array([n for _, n in top], np.float64) + ADD), [0.0, np.log10(ends + ADD)]])
    log_all = float(np.log10(tokens + ADD * (kinds + 1)))
    rare = sums.get(TOTAL, 0) - sum(n for _, n in top)
    mass = rare + ADD * (sums.get(KINDS, 0) - len(top) + 1)
    log_rare = float(np.log10(mass))

    scored = texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(score_texts(vocabulary, base_in, log_p / np.log(10), ends > 0, parts), ROWS_SQL)
    learned = checkpointed(dealt(scored).mapInArrow(learn_rare(core, pairs, mass), ROWS_SQL))
    shares = [np.frombuffer(r["payload"]) for r in learned.where(F.col("kind") == SHARES).orderBy("part").select("payload").collect()]
    log_shares = np.log(sum(shares, np.full(shape[0], ADD / mass)))
    met = learned.mapInArrow(meet_vectors(parts, core, log_shares), ROWS_SQL)
    return dealt(met).mapInArrow(add_up(tokens, log_all, log_rare), RESULT)
