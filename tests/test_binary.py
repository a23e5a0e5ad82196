"""Binary files made here, byte by byte."""

from __future__ import annotations

import struct
import zlib

import pytest

from quillstream.sources.parsers import parse
from quillstream.sources.parsers.binary import END, FREE, CompoundFile, _rk
from quillstream.sources.parsers.pdf import count_pages, parse_page_range
from quillstream.sources.parsers.pdf import parse as parse_pdf


def compound(**streams: bytes) -> bytes:
    """A compound file whose streams are all long ones, each padded to the cutoff."""
    size, cutoff = 512, 4096
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        start = len(sectors)
        parts = [data[i : i + size].ljust(size, b"\0") for i in range(0, len(data), size)]
        for k, p in enumerate(parts):
            sectors.append(p)
            fat.append(start + k + 1 if k + 1 < len(parts) else END)
        return start

    entry = lambda name, kind, start, n: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, n)
    placed = {n: (put(d.ljust(cutoff, b"\0")), max(len(d), cutoff)) for n, d in streams.items()}
    folder = put((entry("Root Entry", 5, END, 0) + b"".join(entry(n, 2, *v) for n, v in placed.items())).ljust(1024, b"\0"))
    at = len(sectors)
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(size, b"\xff")
    assert len(table) == size
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, folder, 0, cutoff, END, 0, END, 0)
    return head + struct.pack("<109I", at, *[FREE] * 108) + b"".join(sectors) + table


def test_streams():
    c = CompoundFile(compound(A=b"abc", Bb=b"x" * 5000))
    assert c.stream("A")[:3] == b"abc" and c.stream("Bb").startswith(b"x" * 5000) and c.stream("C") is None
    with pytest.raises(ValueError):
        CompoundFile(b"no")


def test_doc():
    text = "Intro\rcell\x07two\x07\x07last \x13 HYPERLINK \"u\" \x14link\x15\r"
    main = bytearray(1024)
    struct.pack_into("<H", main, 10, 0x200)
    struct.pack_into("<i", main, 76, len(text))
    main += text.encode("utf-16-le")
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 1024, 0)
    struct.pack_into("<II", main, 418, 0, len(clx))
    got = parse("doc", compound(WordDocument=bytes(main), **{"1Table": clx}))
    assert got[0]["text"] == "Intro" and any("last link" in (n.get("text") or "") or "last link" in str(n.get("table")) for n in got)


def test_xls():
    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    s = lambda t: struct.pack("<HB", len(t), 0) + t.encode()
    sheet = rec(0x809, b"\0" * 16) + rec(0xFD, struct.pack("<HHHI", 0, 0, 0, 1)) + rec(0x203, struct.pack("<HHHd", 0, 1, 0, 2.5)) + rec(0x27E, struct.pack("<HHHI", 1, 0, 0, 7 << 2 | 2)) + rec(0x0A, b"")
    start = rec(0x809, b"\0" * 16) + rec(0xE0, b"\0" * 20) + rec(0xFC, struct.pack("<II", 2, 2) + s("a") + s("name"))
    bound = lambda at: rec(0x85, struct.pack("<IH", at, 0) + b"\x01\x00S")
    head = start + bound(0) + rec(0x0A, b"")
    got = parse("xls", compound(Workbook=start + bound(len(head)) + rec(0x0A, b"") + sheet))
    assert got[0]["table"]["rows"] == [["name", "2.5"], ["7", ""]]
    assert _rk(5 << 2 | 3) == 0.05 and _rk(0x3FF00000) == 1.0


def test_ppt():
    rec = lambda kind, body, box=False: struct.pack("<HHI", 15 if box else 0, kind, len(body)) + body
    slide = lambda t: rec(0x3F3, b"\0" * 20) + rec(0xF9F, struct.pack("<I", 0)) + rec(0xFA8, t) + rec(0xF9F, struct.pack("<I", 1)) + rec(0xFA0, "x\ry".encode("utf-16-le"))
    got = parse("ppt", compound(**{"PowerPoint Document": rec(0x3E8, rec(0xFF0, slide(b"One") + slide(b"Two"), True), True)}))
    assert [(n["kind"], n.get("text")) for n in got] == [("heading", "One"), ("list_item", "x"), ("list_item", "y"), ("page_break", None), ("heading", "Two"), ("list_item", "x"), ("list_item", "y")]


def pdf(*contents: bytes) -> bytes:
    n = len(contents)
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(n))
    out = b"%%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[%s]/Count %d/MediaBox[0 0 612 792]>> endobj\n5 0 obj <</Type/Font/Subtype/Type1>> endobj\n" % (kids, n)
    for k, c in enumerate(contents):
        z = zlib.compress(c)
        out += b"%d 0 obj <</Type/Page/Parent 2 0 R/Contents %d 0 R/Resources<</Font<</F 5 0 R>>>>>> endobj\n%d 0 obj <</Length %d/Filter/FlateDecode>>\nstream\n" % (10 + 2 * k, 11 + 2 * k, 11 + 2 * k, len(z)) + z + b"\nendstream endobj\n"
    return out + b"%%EOF"


def test_pdf():
    f = pdf(b"BT /F 12 Tf 72 700 Td (Hello) Tj 40 0 Td [(wor) -20 (ld)] TJ 0 -14 TD (again) Tj 0 -60 Td (far \\(x\\)) Tj ET", b"BT /F 12 Tf 1 0 0 1 72 700 Tm <41> Tj ET")
    assert count_pages(f) == 2
    got = parse("pdf", f)
    assert [n["kind"] for n in got] == ["paragraph", "paragraph", "page_break", "paragraph"] and got[1]["text"] == "far (x)" and got[3]["text"] == "A" and "Hello" in got[0]["text"]
    assert [n.get("text") for n in parse_pdf(f, pages="2")] == ["A"]


@pytest.mark.parametrize("s, want", [("2-5", (2, 5)), ("3", (3, 3)), ("4-", (4, None)), (None, (1, None)), ("-2", (1, 2))])
def test_page_ranges(s, want):
    assert parse_page_range(s) == want


@pytest.mark.parametrize("s", ["5-2", "x", "0-1", "-"])
def test_bad_page_ranges(s):
    with pytest.raises(ValueError):
        parse_page_range(s)
