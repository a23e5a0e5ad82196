"""Suffix sorting in blocks, with a difference cover.

Ranks of the suffixes at the positions of a difference cover modulo v are found first (prefix doubling over the cover
only). The suffixes asked for are then sorted one bucket at a time: by their first v bytes, and where those tie, by ranks:
any two positions have an offset below v at which both are in the cover. Memory is that of the ranks and one bucket.
"""

from __future__ import annotations

from functools import cache

import numpy as np

COVERS = {4: (0, 1, 2), 8: (0, 1, 2, 4), 16: (0, 1, 2, 5, 8), 32: (0, 1, 2, 3, 7, 11, 19)}


@cache
def offsets(v: int) -> np.ndarray:
    """offsets(v)[a, b]: the least d for which a + d and b + d are both in the cover, modulo v."""
    inside = np.zeros(v, bool)
    inside[list(COVERS[v])] = True
    out = np.full((v, v), -1, np.int64)
    for a in range(v):
        for b in range(v):
            out[a, b] = next(d for d in range(v) if inside[(a + d) % v] and inside[(b + d) % v])
    return out


def words_at(padded: np.ndarray, at: np.ndarray, count: int) -> list[np.ndarray]:
    """count big-endian words of 8 bytes from each position; padded goes on for as many bytes after the last."""
    every = np.ndarray((padded.size - 7,), ">u8", np.ascontiguousarray(padded), 0, (1,))
    return [every[at + 8 * k].astype(np.uint64) for k in range(count)]


def _lead(buf_size: int, padded: np.ndarray, at: np.ndarray, v: int) -> list[np.ndarray]:
    """Keys that order suffixes by their first v bytes; one that ends there comes before one that goes on."""
    keys = words_at(padded, at, v // 8) if v >= 8 else [padded[at + j] for j in range(v)]
    left = np.minimum(buf_size - at, v)
    return [*keys, left] if left.size and left.min() < v else keys


def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Rank of each row among distinct rows; how many there are."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(order.size, bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(order.size, np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(rank[order[-1]]) + 1 if order.size else 0


def cover_ranks(buf: np.ndarray, padded: np.ndarray, v: int, depth: int | None = None) -> np.ndarray:
    """For each position of the cover its suffix's rank among them; -1 elsewhere and past the end.

    With a depth, suffixes that agree on that many bytes may share a rank.
    """
    n = buf.size
    at = np.flatnonzero(np.isin(np.arange(v), COVERS[v])[np.arange(n) % v])
    place = np.full(n + 2 * v, -1, np.int64)
    rank, kinds = _dense(_lead(n, padded, at, v))
    step = v
    while kinds < at.size and (depth is None or step < depth):
        place[at] = rank
        ahead = at + step
        after = np.where(ahead < n, place[np.minimum(ahead, n)], -1)
        rank, kinds = _dense([rank * np.int64(kinds + 1) + after + 1])
        step *= 2
    place[at] = rank
    return place


def _untie(at: np.ndarray, group: np.ndarray, ranks: np.ndarray, v: int) -> np.ndarray:
    """Order of positions whose groups (ascending numbers) agree on v bytes: by group, then by suffix."""
    n, off, kind = at.size, offsets(v), at % v
    group = group - group[0]
    wide, last = np.int64(ranks.size + 2), ranks.size - 1
    behind = np.zeros(n, np.int64)
    classes = {c: np.flatnonzero(kind == c) for c in np.unique(kind).tolist()}
    edges = np.arange(group[-1] + 1)
    first = {c: np.searchsorted(group[x], edges) for c, x in classes.items()}  # of each group in a class
    keys: dict[tuple[int, int], np.ndarray] = {}  # (class, offset): group and rank, in place

    def key(c: int, d: int) -> np.ndarray:
        if (c, d) not in keys:
            x = classes[c]
            keys[c, d] = group[x] * wide + ranks[np.minimum(at[x] + d, last)] + 1
        return keys[c, d]

    ordered: dict[tuple[int, int], np.ndarray] = {}
    for c, mine in classes.items():
        for d in classes:
            o = int(off[c, d])
            if (d, o) not in ordered:
                ordered[d, o] = np.sort(key(d, o))
            behind[mine] += np.searchsorted(ordered[d, o], key(c, o)) - first[d][group[mine]]
    return np.lexsort((behind, group))


def sort_suffixes(buf: np.ndarray, starts: np.ndarray | None = None, v: int = 32, block: int = 1 << 20, depth: int | None = None) -> np.ndarray:
    """starts (all positions if None) in the order of the suffixes of buf that begin there.

    With a depth, the order among suffixes that agree on so many bytes is left open; they still stand together.

    Buckets are ranges of the first two bytes with about `block` suffixes each; one is sorted at a time.
    """
    n = buf.size
    starts = np.arange(n) if starts is None else np.asarray(starts, np.int64)
    if starts.size == 0:
        return starts
    padded = np.concatenate([buf, np.zeros(v + 8, np.uint8)])
    ranks = cover_ranks(buf, padded, v, depth)
    lead = padded[starts].astype(np.int64) << 8 | padded[starts + 1]
    ends = np.cumsum(np.bincount(lead, minlength=1 << 16))
    out, low = [], 0
    while low < 1 << 16:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + block, "right")))
        bucket = starts[(lead >= low) & (lead < high)]
        low = high
        if not bucket.size:
            continue
        keys = _lead(n, padded, bucket, v)
        order = np.lexsort(keys[::-1])
        new = np.ones(order.size, bool)
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        bucket, group = bucket[order], np.cumsum(new)
        tied = np.bincount(group)[group] > 1
        if tied.any():
            at = np.flatnonzero(tied)
            bucket[at] = bucket[at][_untie(bucket[at], group[at], ranks, v)]
        out.append(bucket)
    return np.concatenate(out)
