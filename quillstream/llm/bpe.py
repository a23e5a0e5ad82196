"""BPE by a tokenisation automaton.

The automaton runs over tokens: its language is the set of token sequences that the merges produce. It starts as one state
with a loop for every byte. A merge (u, v) -> w adds a gadget: the state that u leads to loses its arc v, and wherever u
leaves, an arc w is laid to where v led then. Gadgets are added in the order of the merges. A state is therefore known by
the token that led to it, and copies are made only of the arcs that it has lost.

An arc v that is lost at some time takes with it what starts with v and is merged later. In a preorder of the tokens by
their first pieces, later merges before earlier ones, that is one interval. So the compiled table has for each state a few
intervals of tokens that may not follow; all other arcs are there. It is compiled once, on the driver.

A word is encoded in one pass over its bytes, in time linear in its length: every prefix ends in exactly one state, and
from there each token that the word goes on with is either an arc or not. Nothing is taken back. Words that are new are
encoded together, a table look-up for all of them at a time. Decoding emits the arcs' labels.

Texts are split with the pattern of byte-level BPE before that, and the ids of words kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.runtime import ship

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where splitting at single spaces could cut what the pattern keeps together.
RUNS = re.compile(r"\s (?:\s|\Z)")
#: Words and arcs remembered; a word this long isn't; characters encoded at once; positions matched at once.
WORDS_KEPT, ARCS_KEPT, LONG, GROUP, BLOCK = 400_000, 1 << 20, 64, 1 << 20, 1 << 18
SHIFT = 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def add_gadgets(merges: list[tuple[int, int, int]], tokens: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges (u, v, w) in order to (place of each token in the preorder or -1, first and last + 1 of the intervals).

    Intervals are of keys state << SHIFT | place, ascending by their first; state 0 is the start, i + 1 that after token i.
    """
    first = {}  # merged token: its first piece
    lost: dict[int, dict[int, int]] = {i: {} for i in tokens}  # of the state after each token: arc lost, and when
    done = []
    born: dict[int, int] = {}
    for time, (u, v, w) in enumerate(merges):
        if w in first or u not in lost or v not in lost:
            continue
        piece, until = v, time  # is there an arc v to cut? else the merge never happens
        while piece is not None and lost[u].get(piece, FOREVER) > until:
            until, piece = born.get(piece, -1), first.get(piece)
        if piece is not None:
            continue
        first[w], born[w] = u, time
        lost[w] = dict(lost[v])
        lost[u][v] = time
        done.append((u, v, w, time))
    size = dict.fromkeys(lost, 1)
    for u, _, w, _ in reversed(done):
        size[u] += size[w]
    place, at = {}, 0
    for i in lost:
        if i not in first:
            place[i] = at
            at += size[i]
    end = {i: p + size[i] for i, p in place.items()}  # of what is merged from i from now on
    cut: dict[int, int] = {}  # where the interval of the arc lost then ends
    for u, v, w, time in done:
        cut[time] = end[v]  # w too, if u is v
        place[w] = end[u] - size[w]
        end[w] = end[u]
        end[u] = place[w]
    places = np.full(max(lost) + 1, -1, np.int64)
    places[list(place)] = list(place.values())
    state = np.repeat(np.array(list(lost)) + 1, [len(x) for x in lost.values()]) << SHIFT
    lo = state | places[np.fromiter((v for x in lost.values() for v in x), np.int64, state.size)]
    hi = state | np.fromiter((cut[t] for x in lost.values() for t in x.values()), np.int64, state.size)
    order = np.argsort(lo)
    return places, np.append(0, lo[order]), np.append(0, np.maximum.accumulate(hi[order]))


FOREVER = 1 << 60


class Automaton:
    """merges: pairs of tokens (bytes) in order; ids: token to id; special: literal strings with ids of their own."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int], special: dict[str, int]):
        self.special = special
        self.labels: list[bytes] = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            self.labels[i] = token
        for s, i in special.items():
            self.labels[i] = s.encode()
        places, self.lo, self.hi = add_gadgets([(ids[a], ids[b], ids[a + b]) for a, b in merges], [i for t, i in ids.items() if len(t) == 1])
        self.place = np.append(places, np.full(len(self.labels) - places.size, -1))
        self.size = np.array([len(x) for x in self.labels])
        # a trie of the automaton's tokens, as a sorted table of (node, byte)
        steps: dict[int, int] = {}
        at: dict[int, int] = {}
        for token, i in ids.items():
            if self.place[i] < 0:
                continue
            node = 0
            for byte in token:
                node = steps.setdefault(node << 8 | byte, len(steps) + 1)
            at[node] = i
        self.steps = np.array(sorted(steps), np.int64)
        self.leads = np.array([steps[k] for k in self.steps.tolist()], np.int64)
        self.token_at = np.full(len(steps) + 1, -1, np.int64)
        self.token_at[list(at)] = list(at.values())
        self._start()

    def _start(self) -> None:
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.arcs: dict[int, bool] = {}
        self.splitter = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "chunks", "arcs", "splitter")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._start()

    def has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = state << SHIFT | self.place[token]
        return self.hi[np.searchsorted(self.lo, key, "right") - 1] <= key

    def matches(self, a: np.ndarray, first: int, last: int, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, token) of the tokens that start at positions first to last; none crosses stop (of its position)."""
        at, node = np.arange(first, last), np.zeros(last - first, np.int64)
        found, k = [], 0
        while at.size:
            key = node << 8 | a[at + k]
            step = np.minimum(np.searchsorted(self.steps, key), self.steps.size - 1)
            on = self.steps[step] == key
            at, node = at[on], self.leads[step[on]]
            k += 1
            token = self.token_at[node]
            hit = token >= 0
            found.append((at[hit], token[hit]))
            on = at + k < stop[at - first]
            at, node = at[on], node[on]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-split words, four bytes each, little-endian; all words take their step at one offset together."""
        size = np.array([len(w) for w in words])
        end = np.cumsum(size)
        a = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        which = np.repeat(np.arange(size.size), size)
        at, token = self.matches(a, 0, a.size, end[which])
        word = which[at]
        offset = at - (end - size)[word]
        order = np.argsort(offset, kind="stable")
        at, token = (at + word)[order], token[order]  # a word of n bytes has n + 1 places
        state = np.full(a.size + size.size, -1, np.int64)
        state[end - size + np.arange(size.size)] = 0
        for i, j in zip(*(lambda c: (np.append(0, c), np.append(c, at.size)))(np.flatnonzero(np.diff(offset[order])) + 1)):
            p, w = at[i:j], token[i:j]
            go = (state[p] >= 0) & self.has_arc(np.maximum(state[p], 0), w)
            state[p[go] + self.size[w[go]]] = w[go] + 1
        here, place, out = np.arange(size.size), end + np.arange(size.size), []
        left = size.copy()
        while here.size:
            w = state[place] - 1
            if w.min() < 0:
                raise ValueError("no path for a word")
            out.append((here, w))
            left -= self.size[w]
            place = place - self.size[w]
            on = left > 0
            here, place, left = here[on], place[on], left[on]
        here, w = (np.concatenate([x[k] for x in out[::-1]]) for k in (0, 1)) if out else (np.zeros(0, np.int64),) * 2
        order = np.argsort(here, kind="stable")
        packed = w[order].astype("<u4").tobytes()
        cut = np.append(0, 4 * np.cumsum(np.bincount(here, minlength=size.size))).tolist()
        return [packed[i:j] for i, j in zip(cut, cut[1:])]

    def encode_long(self, word: bytes) -> bytes:
        """The same for one word of any length, place by place."""
        n, arcs = len(word), self.arcs
        a = np.frombuffer(word, np.uint8).astype(np.int64)
        state, size, place = array("i", [-1]) * (n + 1), self.size.tolist(), self.place.tolist()
        state[0] = 0
        for first in range(0, n, BLOCK):
            last = min(n, first + BLOCK)
            at, token = self.matches(a, first, last, np.full(last - first, n))
            order = np.argsort(at, kind="stable")
            for p, w in zip(at[order].tolist(), token[order].tolist()):
                s = state[p]
                arc = arcs.get(s << SHIFT | w)
                if arc is None:
                    if len(arcs) >= ARCS_KEPT:
                        arcs.clear()
                    key = s << SHIFT | place[w]
                    arc = arcs[s << SHIFT | w] = s >= 0 and bool(self.hi[self.lo.searchsorted(key, "right") - 1] <= key)
                if arc:
                    state[p + size[w]] = w + 1
        out, p = array("I"), n
        while p:
            if state[p] < 1:
                raise ValueError("no path for a word")
            out.append(state[p] - 1)
            p -= size[out[-1]]
        return np.array(out, "<u4")[::-1].tobytes()

    def path(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word."""
        return np.frombuffer(self.encode_long(word), "<u4").tolist()

    def learn(self, chunks: list[str]) -> list[str]:
        """Keep the ids of chunks (what stands between the places where texts may be cut); gives those to be dropped after use."""
        if self.splitter is None:
            import regex

            self.splitter = regex.compile(PATTERN)
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        known, words = self.chunks, self.words
        if len(known) >= WORDS_KEPT or not known:
            known.clear()
            known.update((s, np.array([i], "<u4").tobytes()) for s, i in self.special.items())
        new = {c: self.splitter.findall(c) for c in set(chunks).difference(known)}
        unmet = list({w for ws in new.values() for w in ws if len(w) < LONG and w not in words})
        if unmet:
            words.update(zip(unmet, self.encode_words([w.encode() for w in unmet])))
        get = lambda w: words[w] if len(w) < LONG else self.encode_long(w.encode())
        known.update((c, b"".join(map(get, ws))) for c, ws in new.items())
        return [c for c in new if len(c) >= LONG]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, four bytes each, little-endian; literal special tokens in them become theirs."""
        parts: list[list[str]] = []
        cutter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        for text in texts:
            out: list[str] = []
            for x in cutter.split(text) if cutter and any(s in text for s in self.special) else (text,):
                if x in self.special or RUNS.search(x):
                    out.append(x)
                elif x:
                    one, *rest = x.split(" ")
                    out += [one, *map(" ".__add__, rest)]
            parts.append(out)
        drop = self.learn([x for p in parts for x in p])
        found = [b"".join(map(self.chunks.__getitem__, p)) for p in parts]
        for c in drop:
            del self.chunks[c]
        return found

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        """The arcs' labels; bytes that aren't UTF-8 become replacement characters, as in the library."""
        out = b"".join(map(self.labels.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        try:
            out.decode()
        except UnicodeDecodeError:
            return out.decode(errors="replace").encode()
        return out


def compile_automaton(spec: str) -> Automaton:
    """From the JSON of a byte-level BPE tokenizer without normaliser, prefix space or post-processor that adds tokens."""
    j = json.loads(spec)
    model, alphabet = j["model"], byte_alphabet()
    if model["type"] != "BPE" or j.get("normalizer") or j["pre_tokenizer"]["type"] != "ByteLevel" or j["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
    special = {x["content"]: x["id"] for x in j["added_tokens"]}
    to_bytes = lambda s: bytes(alphabet[c] for c in s)
    ids = {to_bytes(s): i for s, i in model["vocab"].items() if s not in special}
    merges = [tuple(map(to_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return Automaton(merges, ids, special)


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts of about GROUP characters together."""
    out, held = [], 0
    for t in texts:
        out.append(t)
        held += len(t)
        if held >= GROUP:
            yield out
            out, held = [], 0
    if out:
        yield out


def bpe_rows(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, packed, if asked for).

    path: the tokenizer's JSON, read and compiled by the driver; the automaton is broadcast (its size is fixed by the
    vocabulary: some 20 MB for 50,000 tokens). Null and empty texts have no tokens; repeated rows come out repeated; a long
    text is one row, and takes time and memory in proportion to its length; other columns don't matter. An empty table
    gives an empty result.
    """
    spark = ship(docs.sparkSession)
    with open(path or default_path(), encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(compile_automaton(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            n, ids_sha, dec_sha, kept = [], [], [], []
            for some in groups([t or "" for t in b.column(1).to_pylist()]):
                for ids in a.encode_all(some):
                    n.append(len(ids) // 4)
                    ids_sha.append(sha(ids))
                    dec_sha.append(sha(a.decode(ids)))
                    if with_ids:
                        kept.append(ids)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if with_ids else []), names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
