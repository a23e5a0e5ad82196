"""The text layer of PDF files: objects, content streams, glyph positions, lines; no rendering, no recognition."""

from __future__ import annotations

import re
import zlib

from quillstream.operators.layout import Box, lines_of_glyphs
from quillstream.sources.parsers.nodes import escape, node, paragraph

TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]]|/[^\s<>\[\]()/%]*|<[0-9A-Fa-f\s]*>|\(|[-+]?\d*\.?\d+|[^\s<>\[\]()/%]+")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Ref(int):
    pass


class Op(str):
    pass


class Stream(dict):
    raw = b""


def string_at(s: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(s):
        c = s[at : at + 1]
        if c == b"\\":
            n = s[at + 1 : at + 2]
            if m := re.match(rb"[0-7]{1,3}", s[at + 1 : at + 4]):
                out.append(int(m[0], 8) & 255)
                at += 1 + len(m[0])
                continue
            out += ESCAPES.get(n, b"" if n in b"\r\n" else n)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at + 1
        out += c
        at += 1
    return bytes(out), at


def read(s: bytes, at: int = 0, end: int | None = None):
    """Values and operators in order, as (value, where it ends)."""
    end = len(s) if end is None else end
    stack: list[list] = []
    while at < end and (m := TOKEN.search(s, at, end)):
        t, at = m[0], m.end()
        if t.startswith(b"%"):
            continue
        if t in (b"<<", b"["):
            stack.append([t])
            continue
        if t in (b">>", b"]"):
            if not stack:
                continue
            kind, *v = stack.pop()
            value = {str(k): x for k, x in zip(v[::2], v[1::2])} if kind == b"<<" else v
        elif t == b"(":
            value, at = string_at(s, at)
        elif t.startswith(b"<"):
            h = re.sub(rb"\s", b"", t[1:-1])
            value = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        elif t.startswith(b"/"):
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1"))
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            value = float(t) if b"." in t else int(t)
        elif t == b"R" and stack and len(stack[-1]) > 2:
            stack[-1].pop()
            value = Ref(stack[-1].pop())
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(t, Op(t.decode("latin-1")))
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class Document:
    """Objects found by scanning, so broken cross-reference tables don't matter; object streams are opened."""

    def __init__(self, data: bytes):
        self.objects: dict[int, object] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            value, at = next(read(data, m.end()), (None, m.end()))
            if isinstance(value, dict) and (st := re.compile(rb"\s*stream\r?\n").match(data, at)):
                s = Stream(value)
                n = s.get("Length")
                stop = st.end() + n if isinstance(n, int) and not isinstance(n, Ref) and data[st.end() + n :][:12].strip().startswith(b"endstream") else data.find(b"endstream", st.end())
                s.raw = data[st.end() : stop]
                value = s
            self.objects[int(m[1])] = value
        for s in [o for o in self.objects.values() if isinstance(o, Stream) and o.get("Type") == "ObjStm"]:
            body, first = self.data(s), self.get(s.get("First", 0))
            head = [int(v) for v, _ in read(body, 0, first) if isinstance(v, int)]
            for number, off in zip(head[::2], head[1::2]):
                self.objects.setdefault(number, next(read(body, first + off), (None, 0))[0])

    def get(self, x):
        seen = 0
        while isinstance(x, Ref) and seen < 20:
            x, seen = self.objects.get(int(x)), seen + 1
        return x

    def data(self, s: Stream) -> bytes:
        out = s.raw
        f = self.get(s.get("Filter")) or []
        for name in f if isinstance(f, list) else [f]:
            if name == "FlateDecode":
                try:
                    out = zlib.decompressobj().decompress(out)
                except zlib.error:
                    return b""
            elif name == "ASCIIHexDecode":
                out = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", out).decode())
            else:
                return b""
        return out

    def pages(self) -> list[dict]:
        root = next((self.get(o.get("Pages")) for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        out: list[dict] = []

        def walk(n, above: dict, depth: int) -> None:
            if not isinstance(n, dict) or depth > 50:
                return
            here = {k: n.get(k, above.get(k)) for k in ("Resources", "MediaBox")}
            if "Kids" in n:
                for k in self.get(n["Kids"]) or []:
                    walk(self.get(k), here, depth + 1)
            else:
                out.append({**n, **here})

        walk(root, {}, 0)
        return out


class Font:
    def __init__(self, doc: Document, f: dict):
        self.wide = f.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        u = doc.get(f.get("ToUnicode"))
        if isinstance(u, Stream):
            text = doc.data(u)
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
                for a, b in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]*)>", block):
                    self.map[int(a, 16)] = bytes.fromhex(re.sub(rb"\s", b"", b).decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
                for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    start = int.from_bytes(bytes.fromhex(c.decode())[-2:], "big")
                    for k in range(min(int(b, 16) - int(a, 16), 65535) + 1):
                        self.map[int(a, 16) + k] = chr(start + k)
        self.first = doc.get(f.get("FirstChar")) or 0
        self.widths = doc.get(f.get("Widths")) or []

    def glyphs(self, s: bytes):
        step = 2 if self.wide else 1
        for i in range(0, len(s) - step + 1, step):
            code = int.from_bytes(s[i : i + step], "big")
            k = code - self.first
            w = self.widths[k] if not self.wide and 0 <= k < len(self.widths) and isinstance(self.widths[k], (int, float)) else 500
            yield self.map.get(code) or ("" if self.wide else bytes([code]).decode("cp1252", "replace")), w / 1000


def multiply(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def page_glyphs(doc: Document, page: dict) -> list[Box]:
    """Glyph boxes, from the page's top."""
    box = [float(doc.get(v)) for v in doc.get(page.get("MediaBox")) or (0, 0, 612, 792)]
    fonts = {k: Font(doc, doc.get(v) or {}) for k, v in (doc.get((doc.get(page.get("Resources")) or {}).get("Font")) or {}).items()}
    parts = doc.get(page.get("Contents"))
    content = b"\n".join(doc.data(s) for p in (parts if isinstance(parts, list) else [parts]) if isinstance(s := doc.get(p), Stream))
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, saved, tm, line, font = one, [], one, one, None
    size, lead, char, space, scale = 1.0, 0.0, 0.0, 0.0, 1.0
    args: list = []
    out: list[Box] = []

    def show(s: bytes) -> None:
        nonlocal tm
        for text, w in font.glyphs(s) if font else ():
            m = multiply(tm, ctm)
            x, y, tall = m[4], m[5], abs(m[3]) * size or abs(m[1]) * size
            dx = (w * size + char + (space if text == " " else 0)) * scale
            if text.strip():
                out.append(Box(x - box[0], box[3] - y - tall, x - box[0] + w * size * abs(m[0] or m[1]), box[3] - y, text=text, ix=len(out)))
            tm = multiply((1, 0, 0, 1, dx, 0), tm)

    for v, _ in read(content):
        if not isinstance(v, Op):
            args.append(v)
            continue
        try:
            match str(v):
                case "q":
                    saved.append(ctm)
                case "Q":
                    ctm = saved.pop() if saved else one
                case "cm":
                    ctm = multiply(tuple(map(float, args[-6:])), ctm)
                case "BT":
                    tm = line = one
                case "Tf":
                    font, size = fonts.get(str(args[-2])), float(args[-1])
                case "Td" | "TD":
                    if v == "TD":
                        lead = -float(args[-1])
                    tm = line = multiply((1, 0, 0, 1, float(args[-2]), float(args[-1])), line)
                case "Tm":
                    tm = line = tuple(map(float, args[-6:]))
                case "T*" | "'":
                    tm = line = multiply((1, 0, 0, 1, 0, -lead), line)
                    if v == "'":
                        show(args[-1])
                case "TL":
                    lead = float(args[-1])
                case "Tc":
                    char = float(args[-1])
                case "Tw":
                    space = float(args[-1])
                case "Tz":
                    scale = float(args[-1]) / 100
                case "Tj":
                    show(args[-1])
                case "TJ":
                    for x in args[-1]:
                        if isinstance(x, bytes):
                            show(x)
                        else:
                            tm = multiply((1, 0, 0, 1, -float(x) / 1000 * size * scale, 0), tm)
        except (IndexError, TypeError, ValueError):
            pass
        args = []
    return out


def parse_page_range(s: str | None) -> tuple[int, int | None]:
    """"A-B", "A-", "-B" or "A" from 1; an empty or backward range is an error."""
    if not s:
        return 1, None
    m = re.fullmatch(r"\s*(\d*)\s*(-?)\s*(\d*)\s*", s)
    if not m or not (m[1] or m[3]):
        raise ValueError(f"bad page range {s!r}")
    a = int(m[1] or 1)
    b = int(m[3]) if m[3] else None if m[2] else a
    if a < 1 or b is not None and b < a:
        raise ValueError(f"empty page range {s!r}")
    return a, b


def parse(content: bytes, name: str = "", pages: str | None = None) -> list[dict]:
    """Lines in paragraphs: a gap of more than a line's height, or a page's end, parts them."""
    if b"%PDF" not in content[:1024]:
        raise ValueError("not a PDF file")
    doc = Document(content)
    low, high = parse_page_range(pages)
    out: list[dict] = []
    for k, page in enumerate(doc.pages()[low - 1 : high]):
        if k:
            out.append(node("page_break"))
        held: list[Box] = []
        for line in sorted(lines_of_glyphs(page_glyphs(doc, page)), key=lambda b: (b.t, b.l)):
            if held and line.t - held[-1].b > 0.8 * (line.b - line.t):
                out.append(paragraph(escape(" ".join(b.text for b in held))))
                held = []
            held.append(line)
        if held:
            out.append(paragraph(escape(" ".join(b.text for b in held))))
    return out


def count_pages(content: bytes) -> int:
    return len(Document(content).pages())
