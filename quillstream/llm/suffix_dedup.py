"""Removal of byte strings that an earlier document also has, by blockwise suffix sorting.

A document's windows are its byte strings of LENGTH. Sorting all suffixes of a corpus at once isn't needed to find equal
windows: those have the same anchor, the least hash among their GRAM-byte strings, so suffixes are dealt by anchor and
sorted one bucket at a time.

1. Runs of windows with one anchor are blocks; a block is known by its anchor and a hash of its bytes. Blocks meet by
   anchor. One that an earlier document has whole is removed. What repeats inside a task is settled there, so a passage
   that every document has costs one row per task.
2. Blocks whose anchor another document has in another block (a repeated passage starts or ends in them, or a few words
   happen to recur) are compared by their sides: a window holds its anchor and at least 20 bytes more on its left, on its
   right, or 10 on both, so blocks that share none of these three WIDE-byte strings share no window. Those that do send
   their bytes. Windows are put together by hash, bucket by bucket of anchors, and the suffixes of those whose hash two
   documents have are sorted through a difference cover (suffix_array.py); neighbours that share LENGTH bytes are equal.
3. Removed windows return to their documents.

Anchors so frequent that their blocks would crowd one task are found on a sample of documents (which changes where
windows are compared and not what is found); their windows are dealt one by one, by 128 bits of hash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.suffix_array import sort_suffixes, words_at
from quillstream.runtime import checkpointed, ship

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: Of the SPAN places that an anchor can have in a window, each third is served by a string of this length around it.
SIDE = (LENGTH - GRAM) // 3
WIDE = GRAM + 2 * SIDE
#: Bytes hashed at once (fits a cache), windows of a block at most, bytes of contexts sorted at once, text bytes a partition,
#: text bytes whose blocks are held at once.
PIECE, BLOCK, SORTED, PARTITION, HELD = 1 << 18, 64, 1 << 21, 24 << 20, 8 << 20
#: An anchor is frequent if more blocks than one in FREQUENT of the sample's have it; so there are FREQUENT at most.
SAMPLE, FREQUENT = 2_000, 1 << 14
NO_ID = (1 << 63) - 1

_table = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_base = np.uint64(0x9E3779B97F4A7C15)
_mix = np.uint64(0xBF58476D1CE4E5B9)


def rolling(a: np.ndarray, length: int) -> np.ndarray:
    """A polynomial of the bytes' random numbers, from each position."""
    with np.errstate(over="ignore"):
        level, power, size, left = _table[a], _base, 1, length
        out, done = None, 0
        while True:
            if left & 1:
                if out is None:
                    out, done = level, size
                else:  # what is there already, then this
                    m = min(out.size, level.size - done)
                    out = out[:m] * power + level[done : done + m]
                    done += size
            left >>= 1
            if not left:
                break
            level = level[:-size] * power + level[size:]
            power, size = power * power, size * 2
        return out[: a.size - length + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _mix
        return h ^ (h >> np.uint64(29))


_shift = np.uint64(pow(int(_base), GRAM, 1 << 64))


def sides(raw: np.ndarray, g: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Of each block of windows first to last - 1 short hashes of the WIDE bytes that reach 2, 1 and no SIDE to the anchor's left.

    0: none of the block's windows has its anchor there. raw, g: the grams' polynomials and hashes. A block that has its
    anchor more than once gets zeros only, and may share a window with any of the anchor's blocks.
    """
    grams = np.lib.stride_tricks.sliding_window_view(g, SPAN)
    near, far = (grams[x] == anchor[:, None] for x in (first, last - 1))
    place = first + near.argmax(1)
    once = (near.sum(1) == 1) & (far.sum(1) == 1) & (place == last - 1 + far.argmax(1))
    most, least = place - first, place - last + 1  # the anchor's place in a window
    out = np.zeros((first.size, 3), np.uint16)
    for k in range(3):
        at = np.flatnonzero(once & (most >= (2 - k) * SIDE) & (least <= (3 - k) * SIDE))
        start = place[at] - (2 - k) * SIDE
        with np.errstate(over="ignore"):
            out[at, k] = np.maximum(mixed(raw[start] * _shift + raw[start + WIDE - GRAM]) >> np.uint64(48), 1)
    return out


def window_minima(g: np.ndarray) -> np.ndarray:
    m, size = g, 1
    while size * 2 <= SPAN:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < SPAN:
        m = np.minimum(m[: m.size - (SPAN - size)], m[SPAN - size :])
    return m


def blocks_of(texts: list[bytes], frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, hash, text's number, first window, windows) of all blocks of the texts, in order of text and place."""
    return blocks_and_sides(texts, frequent)[:5]


def blocks_and_sides(texts: list[bytes], frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """blocks_of, and the blocks' sides."""
    import xxhash

    out: list[tuple[np.ndarray, ...]] = []
    digest = xxhash.xxh3_64_intdigest

    def flush(group: list[tuple[int, int, bytes]]) -> None:
        """group: (text's number, offset, piece with the bytes its windows reach)."""
        buf = b"".join(x[2] for x in group)
        if len(buf) < LENGTH:
            return
        size = np.array([len(x[2]) for x in group])
        end = np.cumsum(size)
        a = np.frombuffer(buf, np.uint8)
        raw = rolling(a, GRAM)
        g = mixed(raw)
        low = window_minima(g)
        good = np.zeros(low.size + 1, bool)
        new = np.zeros(low.size, bool)
        new[1:] = low[1:] != low[:-1]
        for k in range(len(group)):
            if size[k] >= LENGTH:
                good[end[k] - size[k] : end[k] - LENGTH + 1] = True
                new[end[k] - size[k]] = True
        first = np.flatnonzero(new & good[:-1])
        stop = np.flatnonzero(good[:-1] & ~good[1:]) + 1  # of each piece's windows
        last = np.minimum(np.append(first[1:], low.size), stop[np.searchsorted(stop, first, "right")])
        if (last - first).max(initial=0) > BLOCK:  # periodic text
            n = -(-(last - first) // BLOCK)
            start = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * BLOCK
            last, first = np.minimum(start + BLOCK, np.repeat(last, n)), start
        anchor = low[first]
        if frequent.size and (hot := np.isin(anchor, frequent)).any():  # one window each
            n = np.where(hot, last - first, 1)
            start = np.repeat(first, n) + np.where(np.repeat(hot, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), 0)
            last = np.where(np.repeat(hot, n), start + 1, np.repeat(last, n))
            hot, first, anchor = np.repeat(hot, n), start, np.repeat(anchor, n)
        else:
            hot = None
        side = sides(raw, g, first, last, anchor)
        lo, hi = first.tolist(), (last + (LENGTH - 1)).tolist()
        h = np.fromiter(map(digest, map(buf.__getitem__, map(slice, lo, hi))), np.uint64, first.size)
        if hot is not None:
            at = np.flatnonzero(hot)
            anchor[at] = np.fromiter((digest(buf[lo[i] : hi[i]], 1) for i in at.tolist()), np.uint64, at.size)
        piece = np.searchsorted(end, first, "right")
        number, offset = np.array([x[0] for x in group]), np.array([x[1] for x in group])
        out.append((anchor, h, number[piece], (first - (end[piece] - size[piece]) + offset[piece]), (last - first), side))

    group: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t)), PIECE):
            part = t[at : at + PIECE + LENGTH - 1] if len(t) > PIECE else t
            if len(part) < LENGTH:
                continue
            group.append((i, at, part))
            held += len(part)
            if held >= PIECE:
                flush(group)
                group, held = [], 0
    flush(group)
    if not out:
        return *(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64)), np.zeros((0, 3), np.uint16)
    return tuple(np.concatenate(c) for c in zip(*out))


# A message: blocks of documents, packed. Documents first, then one entry a block, by document and place.

#: A key: 96 bits of one hash of the text and its CRC, which SQL has too.
KEY = np.dtype([("a", "<u8"), ("b", "<u4"), ("crc", "<u4")])
ID, START, WIDTH = np.int64, np.uint32, np.uint8


HASH, SIDES = np.dtype("<u8"), np.dtype(("<u2", (3,)))


def pack(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, start: np.ndarray, width: np.ndarray, *more: np.ndarray) -> bytes:
    """doc: each block's row in ids and keys; blocks of a document stand together. Keys that are all zero take no space."""
    new = np.ones(doc.size, bool)
    new[1:] = doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, doc.size))
    step = np.diff(start.astype(np.int64), prepend=0)
    step[at] = start[at]
    short = step.size > 0 and 0 <= step.min() and step.max() < 65536
    few = count.max(initial=0) < 65536
    key = keys[doc[at]].tobytes()
    keyed = any(key)
    head = struct.pack("<iiB", at.size, doc.size, short + 2 * few + 4 * keyed)
    return b"".join([head, ids[doc[at]].astype(ID).tobytes(), key if keyed else b"", count.astype(np.uint16 if few else np.uint32).tobytes(), (step.astype(np.uint16) if short else start.astype(START)).tobytes(), width.astype(WIDTH).tobytes(), *[m.tobytes() for m in more]])


def unpack(data: bytes, more: tuple[np.dtype, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """ids, keys, [doc, start, width, more ...] and where the message ends."""
    docs, n, kind = struct.unpack_from("<iiB", data)
    at = 9

    def take(kind: type | np.dtype, count: int) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(data, kind, count, at)
        at += a.nbytes
        return a

    ids = take(ID, docs)
    keys = take(KEY, docs) if kind & 4 else np.zeros(docs, KEY)
    count = take(np.uint16 if kind & 2 else np.uint32, docs).astype(np.int64)
    if kind & 1:
        step = np.cumsum(take(np.uint16, n).astype(np.int64))
        first = np.cumsum(count) - count
        base = np.where(first > 0, step[first - 1], 0) if n else first
        start = (step - np.repeat(base, count)).astype(START)
    else:
        start = take(START, n)
    return ids, keys, [np.repeat(np.arange(docs, dtype=np.int32), count), start, take(WIDTH, n), *[take(m, n) for m in more]], at


def unpack_all(messages: list[bytes], more: tuple[np.dtype, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """The messages' documents in one table, their columns, and where each ends."""
    ids, keys, cols, ends = zip(*(unpack(m, more) for m in messages))
    base = np.cumsum([0, *(i.size for i in ids[:-1])])
    for c, x in zip(cols, base.tolist()):
        c[0] = c[0] + np.int32(x)
    return np.concatenate(ids), np.concatenate(keys), [np.concatenate(c) for c in zip(*cols)], list(ends)


BLOCKS, FLAGS, OPEN, TEXT, BYTES = 0, 1, 2, 3, 4  # kinds of rows
ROWS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
ROWS_SQL = "part int, kind int, payload binary"


def _doc_part(ids: np.ndarray, keys: np.ndarray, parts: int) -> np.ndarray:
    """By id, and where there is none by text."""
    return np.where(ids == NO_ID, keys["crc"].astype(np.int64), ((ids ^ (ids >> 31)) & 0x7FFFFFFF) * 2654435761 >> 16) % parts


def _doc_part_sql(parts: int) -> str:
    return f"cast(if(id = {NO_ID}L, crc32(cast(text as binary)), ((id ^ shiftright(id, 31)) & 2147483647) * 2654435761L >> 16) % {parts} as int)"


def _text_keys(texts: list[bytes], keyed: bool) -> np.ndarray:
    """Tells apart rows with one id, or none, and different texts; zeros if not keyed, which is for ids that differ."""
    import xxhash

    out = np.zeros(len(texts), KEY)
    if not keyed:
        return out
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "<u8").reshape(-1, 2)
    out["a"], out["b"], out["crc"] = both[:, 0], both[:, 1] >> np.uint64(32), np.fromiter(map(zlib.crc32, texts), np.uint32, len(texts))
    return out


def _messages(part: np.ndarray, kind: int, ids: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A message for each part; columns as in pack, and the order of equal parts kept."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.diff(part)) + 1
    cols = [np.split(c[order], cut) for c in columns]
    return [(int(p[0]), kind, pack(ids, keys, *c)) for p, *c in zip(np.split(part, cut), *cols)] if part.size else []


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    p, k, b = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(b, pa.binary())], schema=ROWS)


def _flags(parts: int, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, start: np.ndarray, width: np.ndarray, kind: int = FLAGS, *more: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.lexsort((start, doc))
    return _messages(_doc_part(ids, keys, parts)[doc[order]], kind, ids, keys, *[c[order] for c in (doc, start, width, *more)])


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins, of sorted columns."""
    new = np.ones(keys[0].size, bool)
    if new.size:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(id, text) batches in pieces of some HELD bytes of text."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        texts: list[bytes] = []
        first = held = 0
        for k, t in enumerate(b.column(1), 1):
            texts.append(t.as_py().encode())
            held += len(texts[-1])
            if held >= HELD or k == b.num_rows:
                yield ids[first:k], texts
                first, held, texts = k, 0, []


def emit_blocks(parts: int, frequent: np.ndarray, keyed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            anchor, h, doc, start, width, side = blocks_and_sides(texts, frequent)
            if not anchor.size:
                continue
            keys, own = _text_keys(texts, keyed), ids[doc]
            order = np.lexsort((own, h, anchor))
            at = np.flatnonzero(_groups(anchor[order], h[order]))
            least = np.repeat(own[order[at]], np.diff(np.append(at, order.size)))
            later = np.zeros(order.size, bool)
            later[order] = own[order] > least
            rows = _flags(parts, ids, keys, *[c[later] for c in (doc, start, width)])
            doc, start, width, anchor, h, side = (c[~later] for c in (doc, start, width, anchor, h, side))
            rows += _messages((anchor % np.uint64(parts)).astype(np.int32), BLOCKS, ids, keys, doc, start, width, anchor, h, side)
            yield _batch(rows)

    return run


def _several(own: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Whether the groups that begin at heads have more owners than one."""
    return np.maximum.reduceat(own, heads) != np.minimum.reduceat(own, heads) if own.size else np.zeros(0, bool)


def undecided(anchor: np.ndarray, h: np.ndarray, own: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which of different blocks, sorted by anchor and hash, may share a window with another document's block."""

    def meet(*key: np.ndarray) -> np.ndarray:
        new = _groups(*key)
        heads = np.flatnonzero(new)
        kinds = np.add.reduceat(_groups(*key, h_now).astype(np.int64), heads) if heads.size else heads
        return ((kinds > 1) & _several(own_now, heads))[np.cumsum(new) - 1]

    h_now, own_now = h, own
    out = meet(anchor)
    some = np.flatnonzero(out)
    anchor, h, own, side = anchor[some], h[some], own[some], side[some]
    group = np.cumsum(_groups(anchor)) - 1
    wild = ~side.any(1)
    hit = np.isin(group, group[wild])
    for k in range(side.shape[1]):
        at = np.flatnonzero(side[:, k])
        at = at[np.argsort(group[at] << 16 | side[at, k], kind="stable")]
        h_now, own_now = h[at], own[at]
        hit[at] |= meet(group[at], side[at, k])
    out[some] = hit
    return out


def resolve_blocks(parts: int):
    """Blocks of a range of anchors to FLAGS, and OPEN ones whose bytes must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[bytes] = []
        for b in batches:
            passed = []
            for part, kind, data in zip(*(c.to_pylist() for c in b.columns)):
                if kind == BLOCKS:
                    got.append(data)
                else:
                    passed.append((part, kind, data))
            yield _batch(passed)
        if not got:
            return
        ids, keys, cols, _ = unpack_all(got, (HASH, HASH, SIDES))
        got.clear()
        order = np.argsort(cols[3], kind="stable")
        n = np.diff(np.append(np.flatnonzero(_groups(cols[3][order])), order.size))
        order = order[np.repeat(n > 1, n)]
        doc, start, width, anchor, h, side = (c[order] for c in cols)
        del cols
        order = np.lexsort((ids[doc], h, anchor))
        doc, start, width, anchor, h, side = (c[order] for c in (doc, start, width, anchor, h, side))
        own = ids[doc]
        at = np.flatnonzero(_groups(anchor, h))
        later = own > np.repeat(own[at], np.diff(np.append(at, own.size))) if own.size else np.zeros(0, bool)
        yield _batch(_flags(parts, ids, keys, *[c[later] for c in (doc, start, width)]))
        doc, start, width, anchor, h, side, own = (c[~later] for c in (doc, start, width, anchor, h, side, own))
        left = undecided(anchor, h, own, side)
        yield _batch(_flags(parts, ids, keys, *[c[left] for c in (doc, start, width)], OPEN, anchor[left]))

    return run


TEXTS_SQL = "part int, kind int, payload binary, id long, text string"


def _per_document(rows: list[bytes], more: tuple[np.dtype, ...] = ()) -> dict[tuple[int, bytes], list[np.ndarray]]:
    """Messages to (id, key): [start, width, more ...]."""
    if not rows:
        return {}
    ids, keys, (doc, *cols), _ = unpack_all(rows, more)
    turn = np.lexsort((keys["crc"], keys["b"], keys["a"], ids))
    kept = _groups(ids[turn], keys[turn])  # a document comes in several messages
    number = np.empty(turn.size, np.int64)
    number[turn] = np.cumsum(kept) - 1
    ids, keys = ids[turn[kept]], keys[turn[kept]]
    order = np.lexsort((cols[0], number[doc]))
    cuts = np.flatnonzero(np.diff(number[doc[order]])) + 1
    present = number[doc[order[np.append(0, cuts)]]] if order.size else []
    split = [np.split(c[order], cuts) for c in cols]
    return {(int(ids[k]), keys[k].tobytes()): list(v) for k, *v in zip(present, *split)}


def open_bytes(parts: int, keyed: bool):
    """Texts and OPEN blocks to the blocks' bytes, dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[bytes] = []
        found = None
        for b in batches:
            ids, keys, cols, raws = [], [], [], []
            for kind, payload, own, text in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4))):
                if kind == OPEN:
                    rows.append(payload)
                    continue
                if found is None:  # rows come by kind, texts last
                    found, rows = _per_document(rows, (HASH,)), []
                if not found:
                    continue
                raw = text.encode()
                key = _text_keys([raw], keyed)
                if (f := found.get((own, key.tobytes()))) is not None:
                    start, width, anchor = f
                    cols.append((np.full(start.size, len(ids)), start, width, anchor))
                    ids.append(own)
                    keys.append(key)
                    raws += [raw[s:e] for s, e in zip(start.tolist(), (start + width + np.int64(LENGTH - 1)).tolist())]
            if not ids:
                continue
            doc, start, width, anchor = (np.concatenate(c) for c in zip(*cols))
            own, key = np.array(ids, np.int64), np.concatenate(keys)
            part = (anchor % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            yield _batch([(int(part[g[0]]), BYTES, pack(own, key, *[c[g] for c in (doc, start, width, anchor)]) + b"".join(raws[i] for i in g.tolist())) for g in np.split(order, cut)])

    return run


def equal_windows(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows from starts in suffix order, and a number for each that equal windows share."""
    order = sort_suffixes(buf, starts, depth=LENGTH)
    words = words_at(np.concatenate([buf, np.zeros(LENGTH + 16, np.uint8)]), order, LENGTH // 8 + 1)
    words[-1] >>= np.uint64(8 * (8 - LENGTH % 8))
    return order, np.cumsum(_groups(*words)) - 1


def _laid(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places at, at + 1, ... of each of the sizes, one after the other."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())


def later_windows(buf: np.ndarray, at: np.ndarray, size: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of strings that a string with a smaller owner also has: string's number and place."""
    h = mixed(rolling(buf, LENGTH))
    starts = _laid(at, size - LENGTH + 1)
    member = np.repeat(np.arange(at.size), size - LENGTH + 1)
    h = h[starts]
    order = np.argsort(h)
    new = _groups(h[order])
    heads = np.flatnonzero(new)
    order = order[_several(own[member[order]], heads)[np.cumsum(new) - 1]]
    if not order.size:
        return order, order
    # what the others had is left out, and suffixes of the rest are sorted
    some = np.unique(member[order])
    base = np.cumsum(size[some]) - size[some]
    new_base = np.zeros(at.size, np.int64)
    new_base[some] = base
    member = member[order]
    window, equal = equal_windows(buf[_laid(at[some], size[some])], np.sort(new_base[member] + starts[order] - at[member]))
    number = np.searchsorted(base, window, "right") - 1
    who = own[some[number]]
    heads = np.flatnonzero(_groups(equal))
    later = who > np.minimum.reduceat(who, heads)[equal]
    return some[number[later]], (window - base[number])[later]


def sort_blocks(parts: int):
    """Bytes of blocks to FLAGS of the windows that an earlier document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        messages = [data for b in batches for data in b.column(2).to_pylist()]
        if not messages:
            return
        ids, keys, (doc, start, width, anchor), ends = unpack_all(messages, (HASH,))
        buf = np.frombuffer(b"".join(m[e:] for m, e in zip(messages, ends)), np.uint8)
        messages.clear()
        own, start, size = ids[doc], start.astype(np.int64), width.astype(np.int64) + LENGTH - 1
        at = np.cumsum(size) - size
        order = np.argsort(anchor, kind="stable")
        # buckets: whole anchors, about SORTED bytes each
        fill = np.cumsum(size[order])
        heads = np.flatnonzero(_groups(anchor[order]))
        bucket = np.zeros(order.size, np.int64)
        bucket[heads] = 1 + (fill[heads] - size[order[heads]]) // SORTED
        bucket = np.maximum.accumulate(bucket)
        for chosen in np.split(order, np.flatnonzero(np.diff(bucket)) + 1):
            total = np.cumsum(size[chosen])
            m, p = later_windows(buf[_laid(at[chosen], size[chosen])], total - size[chosen], size[chosen], own[chosen])
            m = chosen[m]
            yield _batch(_flags(parts, ids, keys, doc[m], start[m] + p, np.ones(m.size, np.int64)))

    return run


CLEANED = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"


def cut(text: bytes, flags: list[np.ndarray] | None) -> tuple[np.ndarray, bytes]:
    """Maximal runs of removed bytes, as rows (start, stop), and the bytes that remain; flags: (first window, windows)."""
    if flags is None:
        return np.zeros((0, 2), np.int64), text
    start, width = (c.astype(np.int64) for c in flags)
    n = len(text)
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + width + LENGTH - 1, minlength=n + 1)
    gone = np.cumsum(edge[:n]) > 0
    runs = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    return runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def finish(batches: Iterator[pa.RecordBatch], keyed: bool) -> Iterator[pa.RecordBatch]:
    """Texts and FLAGS to result rows."""
    rows: list[bytes] = []
    found = None
    for b in batches:
        out = []
        for kind, payload, own, text, had in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4, 5))):
            if kind == FLAGS:
                rows.append(payload)
                continue
            if found is None:
                found, rows = _per_document(rows), []
            raw = text.encode()
            runs, kept = cut(raw, found.get((own, _text_keys([raw], keyed).tobytes())))
            out.append((own if had else None, len(raw), [{"start": a, "stop": b} for a, b in runs.tolist()], kept))
        cols = list(zip(*out)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "spans", "kept"])


def frequent_anchors(texts: DataFrame) -> np.ndarray:
    """Anchors that would crowd one task, from SAMPLE texts in the order of a hash; FREQUENT at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor = blocks_of([t.as_py().encode() for t in b.column(0)], np.zeros(0, np.uint64))[0]
            a, n = np.unique(anchor, return_counts=True)
            some = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(a[some].view(np.int64)), pa.array(n[some])], ["anchor", "n"])

    picked = texts.select(F.xxhash64("id", F.octet_length("text")).alias("o"), "id", "text")
    ids = picked.select("o").orderBy("o").limit(SAMPLE)
    top = ids.agg(F.max("o")).first()[0]
    if top is None:
        return np.zeros(0, np.uint64)
    found = picked.where(F.col("o") <= top).select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    most = found.orderBy(F.desc("n"), "anchor").limit(FREQUENT).where(F.col("n") >= SAMPLE // 20).toPandas()
    return np.sort(most["anchor"].to_numpy(np.int64).view(np.uint64))


def clean_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, the spans of bytes removed, and the bytes kept.

    A span can begin or end inside a character, so what is kept is bytes.

    A byte goes if a string of LENGTH bytes that covers it also starts in a row with a smaller doc_id. Null texts count as
    empty; a null doc_id counts as larger than any other; rows with equal ids don't affect each other, so of repeated rows
    all stay or lose the same bytes. An empty table gives an empty result. parts: partitions between the steps, by default
    the session's shuffle partitions, or more where they would hold over PARTITION bytes of text each.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).isNotNull().alias("had"))
    if parts is None:
        total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION + 1)
    frequent = frequent_anchors(texts)
    same = texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.max("id").alias("id")).first()
    keyed = same["n"] is not None and (same["n"] > 1 or same["id"] == NO_ID)
    dealt = lambda df: df.repartitionById(parts, F.col("part"))
    rows = texts.select("id", "text").mapInArrow(emit_blocks(parts, frequent, keyed), ROWS_SQL)
    first = checkpointed(dealt(rows).mapInArrow(resolve_blocks(parts), ROWS_SQL))

    by_doc = texts.selectExpr(f"{_doc_part_sql(parts)} AS part", f"{TEXT} AS kind", "cast(null AS binary) AS payload", "id", "text", "had")

    def with_texts(flags: DataFrame) -> DataFrame:
        """Each document's text in the partition of its messages, after them."""
        both = flags.selectExpr("part", "kind", "payload", "cast(null AS bigint) AS id", "cast(null AS string) AS text", "cast(null AS boolean) AS had").unionByName(by_doc)
        return dealt(both).sortWithinPartitions("kind")

    opened = first.where(F.col("kind") == OPEN)
    flags = first.where(F.col("kind") == FLAGS)
    if not opened.isEmpty():
        strings = checkpointed(with_texts(opened).mapInArrow(open_bytes(parts, keyed), ROWS_SQL))
        flags = flags.unionByName(checkpointed(dealt(strings).mapInArrow(sort_blocks(parts), ROWS_SQL)))
    return with_texts(flags).mapInArrow(lambda batches: finish(batches, keyed), CLEANED)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Digests of clean_texts, one row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    c = clean_texts(docs, id_col=id_col, text_col=text_col, parts=parts)
    return c.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
