"""Formats that hold others: e-mail, MHTML, EPUB, METS archives of scans."""

from __future__ import annotations

import email
import io
import posixpath
import re
import tarfile
import zipfile
from email import policy
from email.utils import getaddresses, parsedate_to_datetime
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from quillstream.sources.parsers import html
from quillstream.sources.parsers.nodes import decode, escape, flat, heading, node, paragraph

#: What one member, and an archive in all, may unpack to.
MEMBER_BYTES, ARCHIVE_BYTES = 256 << 20, 1 << 30


class Package:
    """A ZIP archive read under caps; the parts of office documents and books."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        if sum(i.file_size for i in self.zip.infolist()) > ARCHIVE_BYTES:
            raise ValueError("the archive unpacks to too much")

    def read(self, name: str) -> bytes | None:
        if name not in self.names:
            return None
        if self.zip.getinfo(name).file_size > MEMBER_BYTES:
            raise ValueError(f"{name} unpacks to too much")
        return self.zip.read(name)

    def xml(self, name: str) -> ET.Element | None:
        data = self.read(name)
        return ET.fromstring(data) if data else None

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Relation id to (type's last word, part or address)."""
        folder, base = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], target)
        return out


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def addresses(value: str) -> str:
    return ", ".join(f"{n} <{a}>" if n else a for n, a in getaddresses([value]) if n or a)


def parse_email(content: bytes | str, name: str = "") -> list[dict]:
    """Subject, From, To and Date, then the plain body by blank lines; HTML only if there is no plain one."""
    m = email.message_from_bytes(content if isinstance(content, bytes) else content.encode(), policy=policy.default)
    out = [heading(1, escape(flat(str(m["subject"]))))] if m["subject"] else []
    for k in ("From", "To"):
        if m[k] and (found := addresses(str(m[k]))):
            out.append(paragraph(f"{k}: {escape(found)}"))
    if m["date"]:
        try:
            out.append(paragraph(f"Date: {parsedate_to_datetime(str(m['date'])).isoformat()}"))
        except ValueError:
            out.append(paragraph(f"Date: {escape(flat(str(m['date'])))}"))
    body = m.get_body(("plain",))
    if body is not None:
        out += [paragraph(escape(flat(p))) for p in re.split(r"\n\s*\n", body.get_content().replace("\r\n", "\n")) if p.strip()]
    elif (rich := m.get_body(("html",))) is not None:
        out += html.parse(rich.get_content(), furniture=False)
    return out


def parse_mhtml(content: bytes | str, name: str = "") -> list[dict]:
    m = email.message_from_bytes(content if isinstance(content, bytes) else content.encode(), policy=policy.default)
    root = next((p for p in m.walk() if p.get_content_type() == "text/html"), None)
    return html.parse(root.get_content()) if root is not None else []


def parse_epub(content: bytes, name: str = "") -> list[dict]:
    """Chapters in the order of the spine."""
    p = Package(content)
    box = p.xml("META-INF/container.xml")
    opf = next((e.get("full-path") for e in (box.iter() if box is not None else ()) if local(e.tag) == "rootfile"), None)
    if opf is None:
        raise ValueError("no root file in the book")
    root = p.xml(opf)
    items = {e.get("id"): e for e in root.iter() if local(e.tag) == "item"}
    out: list[dict] = []
    title = next((flat(e.text or "") for e in root.iter() if local(e.tag) == "title"), "")
    if title:
        out.append(heading(1, escape(title), layer="furniture"))
    for ref in (e for e in root.iter() if local(e.tag) == "itemref"):
        it = items.get(ref.get("idref"))
        if it is not None and it.get("media-type") in ("application/xhtml+xml", "text/html"):
            part = posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(it.get("href", ""))))
            if data := p.read(part):
                out += [n for n in html.parse(data, furniture=False) if n.get("layer") != "furniture"]
    return out


def parse_mets(content: bytes, name: str = "") -> list[dict]:
    """A tar archive of scanned pages: the words of its hOCR files, a paragraph a block, pages in order."""
    out: list[dict] = []
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        pages = sorted((m for m in t.getmembers() if m.isfile() and m.name.endswith((".html", ".hocr")) and m.size <= MEMBER_BYTES), key=lambda m: m.name)
        for k, m in enumerate(pages):
            if k:
                out.append(node("page_break"))
            root, _ = html.build(decode(t.extractfile(m).read()))
            for e in root.find_all("p", "div", "span"):
                if "ocr_par" in e.attrs.get("class", "") or "ocrx_block" in e.attrs.get("class", ""):
                    box = [int(x) for x in re.findall(r"bbox (\d+) (\d+) (\d+) (\d+)", e.attrs.get("title", ""))[:1] for x in x] or None
                    if text := flat(e.text()):
                        out.append(paragraph(escape(text), location=box))
    return out
