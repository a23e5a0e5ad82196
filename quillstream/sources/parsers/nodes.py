"""Building nodes and inline text."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace

FIELDS = ("kind", "level", "text", "ordered", "number", "first_in_list", "marker", "href", "layer", "language", "checked", "caption", "table", "fields", "runs", "image", "location", "group_path", "sink_only")


def node(kind: str, text: str | None = None, **more) -> dict:
    return {"kind": kind, "text": text, **more}


def full(n: dict) -> dict:
    """All fields of the schema."""
    return {f: n.get(f) for f in FIELDS}


def heading(level: int, text: str, **more) -> dict:
    return node("heading", text, level=min(max(level, 1), 6), **more)


def paragraph(text: str, **more) -> dict:
    return node("paragraph", text, **more)


def item(text: str, level: int = 0, ordered: bool = False, number: int = 1, first: bool = False, **more) -> dict:
    return node("list_item", text, level=level, ordered=ordered, number=number, first_in_list=first, **more)


def table(rows: list[list[str]], header: list[bool] | None = None, **more) -> dict:
    """Rows are padded to the widest; without header flags the first row is the header."""
    wide = max(map(len, rows), default=0)
    rows = [[*r, *[""] * (wide - len(r))] for r in rows]
    return node("table", table={"rows": rows, "header_rows": header or [i == 0 for i in range(len(rows))], "col_continues": None, "row_continues": None}, **more)


def picture(caption: str | None = None, **more) -> dict:
    return node("picture", caption=caption or None, **more)


def decode(content: bytes | str) -> str:
    if isinstance(content, str):
        return content
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    try:
        return content.decode()
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def flat(s: str) -> str:
    return " ".join(s.split())


def escape(s: str) -> str:
    """What Markdown would take for markup in plain text."""
    return re.sub(r"(?<!\\)_", r"\\_", s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))


def unescape(s: str) -> str:
    return s.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&").replace("\\_", "_")


@dataclass(frozen=True)
class Style:
    bold: bool = False
    italic: bool = False
    underline: bool = False
    strike: bool = False
    code: bool = False
    script: str | None = None
    href: str | None = None

    def with_(self, **kw) -> Style:
        return replace(self, **kw)


def mark(text: str, s: Style) -> str:
    """Markers from the inside out: code, bold, italic, strike, link."""
    out = f"`{text}`" if s.code else escape(text)
    if s.bold:
        out = f"**{out}**"
    if s.italic:
        out = f"*{out}*"
    if s.strike:
        out = f"~~{out}~~"
    return f"[{out}]({s.href})" if s.href else out


def join_runs(runs: list[tuple[str, Style]]) -> str:
    """Runs by single spaces; several runs under one link make one link."""
    out: list[str] = []
    i = 0
    while i < len(runs):
        text, s = runs[i]
        if text == "\n":
            out.append("\n")
            i += 1
            continue
        if s.href:
            j = i
            while j < len(runs) and runs[j][1].href == s.href and runs[j][0] != "\n":
                j += 1
            inner = " ".join(mark(t, x.with_(href=None)) for t, x in runs[i:j])
            out.append(f"[{inner}]({s.href})")
            i = j
            continue
        out.append(mark(text, s))
        i += 1
    return re.sub(r" ?\n ?", "\n", " ".join(out)).strip()


def run_rows(runs: list[tuple[str, Style]]) -> list[dict]:
    return [{"text": t, "bold": s.bold, "italic": s.italic, "underline": s.underline, "strike": s.strike, "script": s.script, "code": s.code, "formula": False, "href": s.href} for t, s in runs if t != "\n"]


def plain(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def mark_leading_furniture(nodes: list[dict]) -> list[dict]:
    """What stands before the first heading of the body; without one nothing."""
    first = next((i for i, n in enumerate(nodes) if n["kind"] == "heading" and not n.get("layer")), None)
    return [n | {"layer": "furniture"} if first is not None and i < first and not n.get("layer") else n for i, n in enumerate(nodes)]
