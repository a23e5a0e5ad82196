"""Plain-Python forms of the operators' contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = b" \t\n\r\x0b\x0c"


def words(t: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def lower(b: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def fingerprint(t: str | None) -> int:
    w = words(lower((t or "").encode()).decode())
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(grams))


def components(items: dict, linked) -> dict:
    """Each key's smallest reachable key."""
    keys = sorted(items)
    root = {k: k for k in keys}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(items[a], items[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def removed(docs: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    return dict(zip([i for i, _ in docs], removed_rows(docs, length)))


def removed_rows(docs: list[tuple[int, str | None]], length: int = 50) -> list[tuple[int, int, int, str]]:
    """Row by row, as ids may repeat."""
    least: dict[bytes, int] = {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            g = b[s : s + length]
            least[g] = min(least.get(g, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def targets(sizes: dict, share: float = 1.5, epochs: float = 2.0) -> dict:
    """Water-filling step by step: clamp, and share again what is left."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > epochs * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = epochs * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(s: str) -> bool:
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(s))) % 10 == 0


def pii(t: str | None) -> list[tuple[str, int, int]]:
    out = []
    for order, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()  # noqa: B023
            if good:
                out.append((m.start(), order, m.end()))
    return [(KINDS[o][0], a, b) for a, o, b in sorted(out)]


def crc(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def unigram(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, held out, tokens, known, N, base)."""
    c: Counter = Counter()
    for i, t in docs:
        if crc(i) % 10:
            c.update([*words(lower((t or "").encode()).decode()), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        w = [*words(lower((t or "").encode()).decode()), None]
        out.append((i, crc(i) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


def groups(pairs) -> dict:
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
