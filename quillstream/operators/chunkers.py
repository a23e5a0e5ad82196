"""Structure-aware chunkers over a document's nodes: hierarchical, token budget, and recursive text splitting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from quillstream.operators.serialize import body, list_line, table_grid
from quillstream.sources.parsers.nodes import unescape

Count = Callable[[str], int]
BUDGET = 256
#: Texts whose count is kept: a document's chunks are counted close together.
COUNTS = 1 << 10


@dataclass
class Chunk:
    text: str
    headings: list[str] | None = None
    doc_items: list[dict] = field(default_factory=list)

    def row(self) -> dict:
        return {"text": self.text, "headings": self.headings, "doc_items": self.doc_items}

    def context(self) -> str:
        return "\n".join([*(self.headings or []), self.text])


def triplets(table: dict) -> str:
    """row, column = value statements; several header rows are joined by dots; tables of one column are their cells."""
    rows, heads = table["rows"], table.get("header_rows") or [True]
    rows = [[(c or "").strip() for c in r] for r in rows]
    n = next((i for i, h in enumerate([*heads, False]) if not h), len(rows)) or 1
    if not rows:
        return ""
    names = [".".join(dict.fromkeys(filter(None, (r[j] for r in rows[:n])))) for j in range(len(rows[0]))]
    data = rows[n:]
    if not data:
        return ". ".join(filter(None, names))
    if len(rows[0]) == 1:
        return ". ".join(f"{names[0]} = {r[0]}" if names[0] else r[0] for r in data if r[0])
    return ". ".join(f"{r[0]}, {name} = {v}" for r in data for name, v in zip(names[1:], r[1:]) if v)


class Refs:
    """References in the order in which the JSON sink numbers its arrays; furniture takes numbers too."""

    ARRAY = {"table": "tables", "picture": "pictures", "chart": "pictures", "field_region": "key_value_items"}

    def __init__(self) -> None:
        self.next: dict[str, int] = {}

    def take(self, n: dict) -> str | None:
        if n["kind"] == "page_break":
            return None
        a = self.ARRAY.get(n["kind"], "texts")
        k = self.next.get(a, 0)
        self.next[a] = k + 1
        if a in ("tables", "pictures") and n.get("caption"):
            self.next["texts"] = self.next.get("texts", 0) + 1
        return f"#/{a}/{k}"


def hierarchical(nodes: list[dict]) -> Iterator[Chunk]:
    """A chunk for each block, and one for each list, under the headings that hold it."""
    refs = Refs()
    shown = {id(n) for n in body(nodes)}
    path: dict[int, str] = {}
    run: list[tuple[dict, str | None]] = []

    def heads() -> list[str] | None:
        return [path[k] for k in sorted(path)] or None

    def done() -> Iterator[Chunk]:
        if run:
            yield Chunk(unescape("\n".join(list_line(n) for n, _ in run)), heads(), [{"self_ref": r, "kind": n["kind"], "text": unescape(n.get("text") or "")} for n, r in run])
            run.clear()

    for n in nodes:
        ref = refs.take(n)
        if id(n) not in shown:
            continue
        kind = n["kind"]
        if kind == "list_item":
            if n.get("first_in_list") and not n.get("level"):
                yield from done()
            run.append((n, ref))
            continue
        yield from done()
        text = unescape(n.get("text") or "")
        if kind == "heading":
            level = 0 if (n.get("level") or 1) == 1 else n["level"] - 1
            for k in [k for k in path if k >= level]:
                del path[k]
            path[level] = text
            continue
        if kind == "code":
            text = f"```\n{n.get('text') or ''}\n```"
        elif kind == "formula":
            text = f"$${n.get('text') or ''}$$"
        elif kind == "checkbox":
            text = f"- [{'x' if n.get('checked') else ' '}] {text}"
        elif kind == "table":
            text = "\n".join(filter(None, (n.get("caption"), unescape(triplets(n["table"])))))
        elif kind == "picture":
            text = n.get("caption") or ""
        elif kind == "chart":
            text = "\n\n".join(filter(None, (n.get("caption"), (n.get("marker") or "").replace("_", " ").capitalize() or None, table_grid(n["table"]) if n.get("table") else None)))
        elif kind == "field_region":
            for f in n.get("fields") or []:
                if said := " ".join(filter(None, (f.get("marker"), f.get("key"), f.get("value")))):
                    yield Chunk(said, heads(), [{"self_ref": ref, "kind": kind, "text": said}])
            continue
        if text.strip():
            yield Chunk(text, heads(), [{"self_ref": ref, "kind": kind, "text": text}])
    yield from done()


# Splitting text to a budget

PUNCTUATION = (".", "?", "!", "*", ";", ",", "(", ")", "[", "]", "“", "”", "‘", "’", "'", '"', "`", ":", "—", "…", "/", "\\", "–", "&", "-")


def splitter_of(text: str) -> tuple[str, bool, list[str]]:
    """The strongest separator in the text: runs of newlines, tabs or spaces (the longest), then marks, then characters."""
    for kind in (r"[\r\n]+", r"\t+", r"\s+"):
        found = re.findall(kind, text)
        if found:
            sep = max(found, key=len)
            if kind == r"\s+" and len(sep) == 1:
                for p in PUNCTUATION:  # a space after punctuation first
                    m = re.search(re.escape(p) + r"(\s)", text)
                    if m:
                        return m[1], True, re.split(rf"(?<={re.escape(p)}){re.escape(m[1])}", text)
            return sep, True, text.split(sep)
    for p in PUNCTUATION:
        if p in text:
            return p, False, text.split(p)
    return "", True, list(text)


def semantic_split(text: str, size: int, count: Count, depth: int = 0) -> list[str]:
    """Pieces within the budget: split at the strongest separator, pieces still too long again, and merged as far as fits."""
    sep, blank, parts = splitter_of(text)
    out: list[str] = []
    lengths = [count(p) for p in parts]
    i = 0
    while i < len(parts):
        if lengths[i] > size and len(parts[i]) > 1:
            out += semantic_split(parts[i], size, count, depth + 1)
            i += 1
        else:
            # the most parts that fit together, by halving
            lo, hi = i + 1, len(parts)
            total, guess = 0, i
            while guess < len(parts) and total + lengths[guess] <= size:
                total += lengths[guess]
                guess += 1
            hi = min(max(guess, i + 1), len(parts))
            while hi > lo and count(sep.join(parts[i:hi])) > size:
                hi = (lo + hi) // 2 if hi - lo > 1 else lo
            out.append(sep.join(parts[i:hi]))
            i = hi
        if not blank and i < len(parts) and out:
            if count(out[-1] + sep) <= size:
                out[-1] += sep
            else:
                out.append(sep)
    return out if depth else [p for p in out if p.strip()]


def prefix_within(text: str, limit: int, count: Count) -> tuple[str, str]:
    """The longest prefix within the limit, back to its last space, and the rest; at least one character."""
    if count(text) <= limit:
        return text, ""
    lo, hi = 0, len(text)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if count(text[:mid]) <= limit:
            lo = mid
        else:
            hi = mid - 1
    at = text.rfind(" ", 0, lo + 1)
    at = at if at > 0 else max(lo, 1)
    return text[:at], text[at:].lstrip(" ")


def split_lines(text: str, prefix: str, limit: int, count: Count) -> list[str]:
    """Lines packed up to the limit, each piece after the prefix if that fits; lines too long are cut."""
    room = limit - count(prefix) if prefix else limit
    if room <= 0:
        prefix, room = "", limit
    out, held = [], ""
    for line in text.splitlines(keepends=True):
        while count(line) > room:
            if held:
                out.append(prefix + held)
                held = ""
            piece, line = prefix_within(line, room, count)
            out.append(prefix + piece)
            if not line:
                break
        if held and count(held + line) > room:
            out.append(prefix + held)
            held = ""
        held += line
    return [*out, prefix + held] if held.strip() else out


class Hybrid:
    """Hierarchical chunks cut to a token budget, and neighbours under the same headings merged while they fit."""

    def __init__(self, count: Count | None = None, budget: int = BUDGET, merge_peers: bool = True):
        self.count, self.budget, self.merge = lru_cache(COUNTS)(count or word_tokens), budget, merge_peers

    def fits(self, c: Chunk) -> bool:
        return self.count(c.context()) <= self.budget

    def by_items(self, c: Chunk) -> Iterator[Chunk]:
        """Windows of items that fit."""
        if self.fits(c) or len(c.doc_items) < 2:
            yield c
            return
        lines = c.text.split("\n")
        held: list[int] = []
        make = lambda ix: Chunk("\n".join(lines[i] for i in ix), c.headings, [c.doc_items[i] for i in ix])
        if len(lines) != len(c.doc_items):
            yield c
            return
        for i in range(len(lines)):
            if held and not self.fits(make([*held, i])):
                yield make(held)
                held = []
            held.append(i)
        yield make(held)

    def by_text(self, c: Chunk) -> Iterator[Chunk]:
        if self.fits(c):
            yield c
            return
        heads = c.headings
        room = self.budget - (self.count("\n".join(heads)) if heads else 0)
        if room <= 0:  # headings alone exceed the budget: they go
            heads, room = None, self.budget
        if any(i["kind"] == "table" for i in c.doc_items):
            parts = split_lines(c.text.replace(". ", ".\n"), "", room, self.count)
        else:
            parts = semantic_split(c.text, room, self.count)
        for p in parts:
            yield Chunk(p, heads, c.doc_items)

    def chunk(self, nodes: list[dict]) -> Iterator[Chunk]:
        held: Chunk | None = None
        for c in (t for h in hierarchical(nodes) for i in self.by_items(h) for t in self.by_text(i)):
            if held is not None and self.merge and held.headings == c.headings:
                both = Chunk(f"{held.text}\n{c.text}", held.headings, [*held.doc_items, *[x for x in c.doc_items if x not in held.doc_items]])
                if self.fits(both):
                    held = both
                    continue
            if held is not None:
                yield held
            held = c
        if held is not None:
            yield held


def word_tokens(text: str) -> int:
    """Words and marks, where no tokenizer is given."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def tokenizer_count(path: str) -> Count:
    """Tokens of a tokenizer file, without truncation, padding or special tokens."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def records(nodes: list[dict], count: Count | None = None, budget: int = BUDGET) -> list[dict]:
    """Chunk records of both chunkers, with their text in context."""
    out = [{"chunker": "hierarchical", **c.row(), "contextualize": c.context()} for c in hierarchical(nodes)]
    return out + [{"chunker": "hybrid", **c.row(), "contextualize": c.context()} for c in Hybrid(count, budget).chunk(nodes)]
