"""Tagged page markup: a tolerant lexer, blocks, tables of cell tokens, location tokens, key-value regions."""

from __future__ import annotations

import re

from quillstream.sources.parsers.nodes import decode, flat, heading, item, node, paragraph, picture

TOKEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9_]*)>|<_([^<>]+)_>")
BLOCK = frozenset("title text paragraph caption footnote page_header page_footer list_item ordered_list unordered_list code formula otsl picture chart checkbox_selected checkbox_unselected key_value_region form section_header document_index".split())
CELLS = ("fcel", "ched", "rhed", "ecel", "lcel", "ucel", "xcel", "srow")


def is_block(tag: str) -> bool:
    return tag in BLOCK or tag.startswith("section_header_level_")


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, value): open, close, text, or language."""
    out, at = [], 0
    for m in TOKEN.finditer(text):
        if t := text[at : m.start()]:
            out.append(("text", t))
        at = m.end()
        if m[3] is not None:
            out.append(("language", m[3]))
        else:
            out.append(("close" if m[1] else "open", m[2]))
    if t := text[at:]:
        out.append(("text", t))
    return out


def grid(tokens: list[tuple[str, str]]) -> dict:
    """Cell tokens to a table: continuations repeat what they continue; a row is a header if all its filled cells are."""
    rows: list[list[tuple[str, str]]] = [[]]
    for kind, value in tokens:
        if kind == "open" and value == "nl":
            rows.append([])
        elif kind == "open" and value in CELLS:
            rows[-1].append((value, ""))
        elif kind == "text" and rows[-1]:
            tag, had = rows[-1][-1]
            rows[-1][-1] = (tag, flat(had + value))
    rows = [r for r in rows if r]
    wide = max(map(len, rows), default=0)
    rows = [[*r, *[("ecel", "")] * (wide - len(r))] for r in rows]
    text = [[t for _, t in r] for r in rows]
    across = [[t in ("lcel", "xcel") for t, _ in r] for r in rows]
    down = [[t in ("ucel", "xcel") for t, _ in r] for r in rows]
    for i in range(len(rows)):
        for j in range(wide):
            if across[i][j] and j:
                text[i][j] = text[i][j - 1]
            elif down[i][j] and i:
                text[i][j] = text[i - 1][j]
    filled = [[t for t, _ in r if t not in ("ecel", "lcel", "ucel", "xcel")] for r in rows]
    return {"rows": text, "header_rows": [bool(f) and all(t == "ched" for t in f) for f in filled], "col_continues": across, "row_continues": down}


def spans(table: dict) -> list[tuple[int, int, int, int, str]]:
    """(row, column, rows, columns, text) of the cells that aren't continuations."""
    rows, across, down = table["rows"], table["col_continues"], table["row_continues"]
    out = []
    for i, r in enumerate(rows):
        for j, t in enumerate(r):
            if across[i][j] or down[i][j]:
                continue
            w = 1
            while j + w < len(r) and across[i][j + w]:
                w += 1
            h = 1
            while i + h < len(rows) and down[i + h][j]:
                h += 1
            out.append((i, j, h, w, t))
    return out


class Reader:
    def __init__(self, text: str):
        self.tokens, self.at, self.out = lex(text), 0, []
        self.location: list[int] = []

    def take(self, tag: str) -> list[tuple[str, str]]:
        """What an element holds; one that isn't closed ends before the next block."""
        inner, depth = [], 0
        while self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind == "close" and value == tag and not depth:
                self.at += 1
                break
            if kind == "open" and is_block(value) and tag not in ("ordered_list", "unordered_list", "key_value_region", "form", "picture", "otsl", "chart"):
                break
            depth += (kind == "open" and value == tag) - (kind == "close" and value == tag)
            inner.append((kind, value))
            self.at += 1
        return inner

    @staticmethod
    def place(inner: list[tuple[str, str]]) -> tuple[list[int] | None, list[tuple[str, str]]]:
        loc = [int(v[4:]) for k, v in inner if k == "open" and re.fullmatch(r"loc_\d+", v)][:4]
        return loc if len(loc) == 4 else None, [x for x in inner if not (x[0] == "open" and re.fullmatch(r"loc_\d+", x[1]))]

    @staticmethod
    def text(inner: list[tuple[str, str]]) -> str:
        return flat("".join(v for k, v in inner if k == "text"))

    def add(self, n: dict, loc: list[int] | None) -> None:
        self.out.append(n | {"location": loc} if loc else n)

    def run(self) -> list[dict]:
        while self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            self.at += 1
            if kind == "text":
                if t := flat(value):
                    self.add(paragraph(t), self.location if len(self.location) == 4 else None)
                    self.location = []
            elif kind == "open" and re.fullmatch(r"loc_\d+", value):
                self.location.append(int(value[4:]))
            elif kind == "open" and value == "page_break":
                self.out.append(node("page_break"))
            elif kind == "open" and is_block(value):
                self.block(value)
        return self.out

    def block(self, tag: str) -> None:
        loc, inner = self.place(self.take(tag))
        if tag.startswith("section_header"):
            level = int(tag.rsplit("_", 1)[1]) if tag[-1].isdigit() else 1
            self.add(heading(min(max(level + 1, 2), 6), self.text(inner)), loc)
        elif tag == "title":
            self.add(heading(1, self.text(inner)), loc)
        elif tag in ("ordered_list", "unordered_list"):
            n = 0
            depth, held = 0, []
            for k, v in inner:
                if v == "list_item" and k == "open":
                    depth, held = 1, []
                elif v == "list_item" and k == "close" or depth and k == "open" and v == "list_item":
                    at, rest = self.place(held)
                    n += 1
                    self.add(item(self.text(rest), 0, tag == "ordered_list", n, n == 1), at)
                    depth = 0
                elif depth:
                    held.append((k, v))
        elif tag == "list_item":
            self.add(item(self.text(inner), first=True), loc)
        elif tag == "code":
            language = next((v for k, v in inner if k == "language"), None)
            self.add(node("code", "".join(v for k, v in inner if k == "text").strip("\n"), language=None if language in (None, "unknown") else language), loc)
        elif tag == "formula":
            self.add(node("formula", self.text(inner)), loc)
        elif tag in ("otsl", "document_index"):
            caption, rest = self.caption(inner)
            if caption:
                self.add(paragraph(caption), None)
            self.add(node("table", table=grid(rest)), loc)
        elif tag in ("picture", "chart"):
            caption, rest = self.caption(inner)
            cells = [i for i, (k, v) in enumerate(rest) if k == "open" and v in CELLS]
            if tag == "chart" or cells:
                self.add(node("chart", table=grid(rest[cells[0] :]) if cells else None, caption=caption), loc)
            else:
                self.add(picture(caption), loc)
        elif tag in ("checkbox_selected", "checkbox_unselected"):
            self.add(node("checkbox", self.text(inner), checked=tag.endswith("_selected")), loc)
        elif tag in ("page_header", "page_footer"):
            self.add(node("page_furniture", self.text(inner), layer="furniture", marker=tag), loc)
        elif tag in ("key_value_region", "form"):
            fields, field = [], None
            for i, (k, v) in enumerate(inner):
                if k == "open" and re.fullmatch(r"(key|value)_\d+", v):
                    what = v.split("_")[0]
                    said = flat(next((x for kk, x in inner[i + 1 :] if kk == "text"), ""))
                    if what == "key" or field is None or field.get("value"):
                        field = {"marker": None, "key": None, "value": None}
                        fields.append(field)
                    field[what] = said
            self.add(node("field_region", fields=fields), loc)
        elif t := self.text(inner):
            self.add(paragraph(t), loc)

    def caption(self, inner: list[tuple[str, str]]) -> tuple[str | None, list[tuple[str, str]]]:
        opens = [i for i, x in enumerate(inner) if x == ("open", "caption")]
        if not opens:
            return None, inner
        a = opens[0]
        b = next((i for i in range(a, len(inner)) if inner[i] == ("close", "caption")), len(inner))
        return self.text(self.place(inner[a:b])[1]) or None, inner[:a] + inner[b + 1 :]


def parse(content: bytes | str, name: str = "") -> list[dict]:
    text = decode(content)
    text = re.sub(r"<\|[^|>]*\|>", "", text)
    return Reader(text).run()
