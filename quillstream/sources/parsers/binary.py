"""Binary office files: compound-file containers, and the text of old word, sheet and slide files."""

from __future__ import annotations

import re
import struct

from quillstream.sources.parsers.nodes import escape, flat, heading, item, node, paragraph, table
from quillstream.sources.parsers.office import DATE_FORMATS, sheet_tables, show_number

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


class CompoundFile:
    """Streams of a compound file by name; chains are read with a cycle guard."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ValueError("not a compound file")
        self.data = data
        self.size = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini_size = 1 << struct.unpack_from("<H", data, 32)[0]
        root_at, self.cutoff, mini_at, more_at = struct.unpack_from("<I4xII4xI", data, 48)
        fat_at = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while more_at not in (FREE, END) and more_at not in seen:
            seen.add(more_at)
            part = self.sector(more_at)
            *more, more_at = struct.unpack(f"<{self.size // 4}I", part)
            fat_at += more
        self.fat = [x for s in fat_at if s not in (FREE, END) for x in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        mini = self.chain(mini_at)
        self.mini_fat = list(struct.unpack(f"<{len(mini) // 4}I", mini))
        self.entries: dict[str, tuple[int, int]] = {}
        folder = self.chain(root_at)
        self.mini = b""
        for i in range(0, len(folder) - 127, 128):
            n, kind = struct.unpack_from("<HB", folder, i + 64)
            start, length = struct.unpack_from("<II", folder, i + 116)
            name = folder[i : i + max(n - 2, 0)].decode("utf-16-le", "replace")
            if kind == 5:
                self.mini = self.chain(start)
            elif kind == 2:
                self.entries.setdefault(name, (start, length))

    def sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size].ljust(self.size, b"\0")

    def chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at not in (FREE, END) and at < len(self.fat) and at not in seen:
            seen.add(at)
            out.append(self.sector(at))
            at = self.fat[at]
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        at, length = self.entries[name]
        if length >= self.cutoff:
            return self.chain(at)[:length]
        out, seen = [], set()
        while at not in (FREE, END) and at < len(self.mini_fat) and at not in seen:
            seen.add(at)
            out.append(self.mini[at * self.mini_size : (at + 1) * self.mini_size])
            at = self.mini_fat[at]
        return b"".join(out)[:length]


def parse_doc(content: bytes, name: str = "") -> list[dict]:
    """The main text by its piece table; built-in heading styles become headings, table rows tables."""
    c = CompoundFile(content)
    main = c.stream("WordDocument") or b""
    flags = struct.unpack_from("<H", main, 10)[0]
    side = c.stream("1Table" if flags & 0x200 else "0Table") or b""
    length = struct.unpack_from("<i", main, 76)[0]
    clx_at, clx_size = struct.unpack_from("<II", main, 418)
    clx = side[clx_at : clx_at + clx_size]
    at = 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    text = ""
    if at < len(clx) and clx[at] == 2:
        size = struct.unpack_from("<I", clx, at + 1)[0]
        plc = clx[at + 5 : at + 5 + size]
        n = (size - 4) // 12
        ends = struct.unpack_from(f"<{n + 1}I", plc)
        for k in range(n):
            where = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * k + 2)[0]
            chars = ends[k + 1] - ends[k]
            if where & 0x40000000:
                a = (where & 0x3FFFFFFF) // 2
                text += main[a : a + chars].decode("cp1252", "replace")
            else:
                text += main[where : where + 2 * chars].decode("utf-16-le", "replace")
    text = re.sub(r"\x13[^\x14\x15]*\x14?|\x15|[\x01\x08]", "", text[:length] if length > 0 else text)
    out: list[dict] = []
    rows: list[list[str]] = []
    for part in re.split(r"[\r\x0c]", text):
        *lines, rest = part.split("\x07\x07")  # a cell's end, and a row's
        rows += [[escape(flat(c)) for c in line.split("\x07")] for line in lines]
        if not rest:
            continue
        if rows:
            out.append(table([r for r in rows if any(r)]))
            rows = []
        if t := flat(re.sub(r"[\x07\x0b]", " ", rest)):
            out.append(paragraph(escape(t)))
    if rows:
        out.append(table([r for r in rows if any(r)]))
    return out


def _string(data: bytes, at: int, wide_count: bool) -> tuple[str, int]:
    n = struct.unpack_from("<H" if wide_count else "<B", data, at)[0]
    at += 2 if wide_count else 1
    flags = data[at]
    at += 1
    runs = ext = 0
    if flags & 8:
        runs = struct.unpack_from("<H", data, at)[0]
        at += 2
    if flags & 4:
        ext = struct.unpack_from("<I", data, at)[0]
        at += 4
    step = 2 if flags & 1 else 1
    text = data[at : at + n * step].decode("utf-16-le" if step == 2 else "latin-1", "replace")
    return text, at + n * step + 4 * runs + ext


def _rk(v: int) -> float:
    x = float(v >> 2 if v < 1 << 31 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


def parse_xls(content: bytes, name: str = "") -> list[dict]:
    """Sheets of BIFF8 workbooks, by the same regions as newer ones."""
    c = CompoundFile(content)
    data = c.stream("Workbook") or c.stream("Book") or b""
    records, at = [], 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        records.append((kind, at + 4, data[at + 4 : at + 4 + size], at))
        at += 4 + size
    shared: list[str] = []
    formats: list[int] = []
    custom: dict[int, str] = {}
    sheets: list[tuple[int, int]] = []
    for i, (kind, _, body, _) in enumerate(records):
        if kind == 0xFC:
            j = i + 1
            while j < len(records) and records[j][0] == 0x3C:  # continued strings
                body += records[j][2]
                j += 1
            total, p = struct.unpack_from("<I", body, 4)[0], 8
            while len(shared) < total and p + 3 <= len(body):
                s, p = _string(body, p, True)
                shared.append(s)
        elif kind == 0xE0 and len(body) >= 4:
            formats.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0x41E:
            custom[struct.unpack_from("<H", body)[0]] = _string(body, 2, True)[0]
        elif kind == 0x85:
            sheets.append((struct.unpack_from("<I", body)[0], body[4] & 3))
    dated = lambda xf: xf < len(formats) and (formats[xf] in DATE_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"', "", custom.get(formats[xf], "")), re.I)))
    out: list[dict] = []
    for k, (start, state) in enumerate(sheets):
        values: dict[tuple[int, int], str] = {}
        merged: list[tuple[int, int, int, int]] = []
        inside = False
        for kind, _, body, where in records:
            if where == start:
                inside = True
            elif inside and kind == 0x0A:
                break
            if not inside:
                continue
            if kind in (0xFD, 0x203, 0x27E, 0x205, 0x204) and len(body) >= 8:
                r, col, xf = struct.unpack_from("<HHH", body)
                if kind == 0xFD:
                    t = shared[struct.unpack_from("<I", body, 6)[0]]
                elif kind == 0x203:
                    t = show_number(repr(struct.unpack_from("<d", body, 6)[0]), dated(xf))
                elif kind == 0x27E:
                    t = show_number(repr(_rk(struct.unpack_from("<I", body, 6)[0])), dated(xf))
                elif kind == 0x205:
                    t = ("True" if body[6] else "False") if not body[7] else "#ERR"
                else:
                    t = _string(body, 6, True)[0]
                if t.strip():
                    values[r, col] = t.strip()
            elif kind == 0xBD:
                r, col = struct.unpack_from("<HH", body)
                for j in range((len(body) - 6) // 6):
                    xf, v = struct.unpack_from("<HI", body, 4 + 6 * j)
                    values[r, col + j] = show_number(repr(_rk(v)), dated(xf))
            elif kind == 0x06 and len(body) >= 14:
                r, col, xf = struct.unpack_from("<HHH", body)
                if body[12:14] != b"\xff\xff":
                    values[r, col] = show_number(repr(struct.unpack_from("<d", body, 6)[0]), dated(xf))
            elif kind == 0xE5:
                for j in range(struct.unpack_from("<H", body)[0]):
                    a, b, cc, d = struct.unpack_from("<HHHH", body, 2 + 8 * j)
                    merged.append((a, cc, b, d))
        if k:
            out.append(node("page_break"))
        found = sheet_tables(values, merged)
        out += [n | {"layer": "invisible"} for n in found] if state else found
    return out


def art_records(data: bytes, at: int = 0, end: int | None = None):
    """(kind, instance, is container, start, end) of drawing and slide records, in order; containers are entered."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        head, kind, size = struct.unpack_from("<HHI", data, at)
        yield kind, head >> 4, head & 15 == 15, at + 8, min(at + 8 + size, end)
        at += 8 if head & 15 == 15 else 8 + size


def parse_ppt(content: bytes, name: str = "") -> list[dict]:
    """Slides' texts: titles become headings, bodies list items, others paragraphs."""
    c = CompoundFile(content)
    data = c.stream("PowerPoint Document") or b""
    out: list[dict] = []
    kind_of, slides, fresh = 4, 0, True
    for kind, _, _, a, b in art_records(data):
        if kind == 0x3F3 and slides:
            out.append(node("page_break"))
        if kind in (0x3F3, 0x3EE):
            slides += kind == 0x3F3
            fresh = True
        elif kind == 0xF9F and b - a >= 4:
            kind_of, fresh = struct.unpack_from("<I", data, a)[0], True
        elif kind in (0xFA0, 0xFA8):
            text = data[a:b].decode("utf-16-le" if kind == 0xFA0 else "latin-1", "replace")
            for line in re.split(r"[\r\x0b]", text):
                if not (t := escape(flat(line))):
                    continue
                if kind_of in (0, 6):
                    out.append(heading(1, t))
                elif kind_of in (1, 5, 7, 8):
                    out.append(item(t, first=fresh))
                    fresh = False
                else:
                    out.append(paragraph(t))
    return out
