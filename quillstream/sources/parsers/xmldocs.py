"""XML dialects: journal articles, patents, business reports, and XML of any other kind."""

from __future__ import annotations

import html as entities
import re
from xml.etree import ElementTree as ET

from quillstream.sources.parsers import html
from quillstream.sources.parsers.containers import local
from quillstream.sources.parsers.nodes import decode, escape, flat, heading, item, node, paragraph, picture, table


def root_of(content: bytes | str) -> ET.Element:
    """The document element; document types go, and named entities become characters."""
    text = decode(content)
    text = re.sub(r"<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "", text, flags=re.S)
    text = re.sub(r"&(?!amp;|lt;|gt;|quot;|apos;|#)([A-Za-z][\w.]*);", lambda m: entities.unescape(m[0]) if entities.unescape(m[0]) != m[0] else f"&amp;{m[1]};", text)
    text = re.sub(r"<\?xml[^>]*\?>", "", text, count=1).strip()
    return ET.fromstring(text)


def said(e: ET.Element | None, skip: tuple[str, ...] = ()) -> str:
    if e is None:
        return ""
    out: list[str] = []

    def walk(x: ET.Element) -> None:
        if local(x.tag) in skip:
            return
        out.append(x.text or "")
        for c in x:
            walk(c)
            out.append(c.tail or "")

    walk(e)
    return flat("".join(out))


def first(e: ET.Element, *tags: str) -> ET.Element | None:
    return next((x for x in e.iter() if local(x.tag) in tags), None)


def every(e: ET.Element, *tags: str) -> list[ET.Element]:
    return [x for x in e.iter() if local(x.tag) in tags]


def table_rows(e: ET.Element) -> tuple[list[list[str]], list[bool]]:
    """HTML or CALS rows; spans repeat their text."""
    rows, header, carried = [], [], {}
    place = {c.get("colname"): i for i, c in enumerate(every(e, "colspec"))}
    for r, tr in enumerate(every(e, "tr", "row")):
        row: list[str] = []
        cells = [c for c in tr if local(c.tag) in ("td", "th", "entry")]
        for c in cells:
            while (r, len(row)) in carried:
                row.append(carried[r, len(row)])
            text = escape(said(c))
            across = int(c.get("colspan", "1") or 1)
            if c.get("namest") in place and c.get("nameend") in place:
                across = place[c.get("nameend")] - place[c.get("namest")] + 1
            down = int(c.get("rowspan", "1") or 1) if c.get("rowspan") else int(c.get("morerows", "0") or 0) + 1
            at = len(row)
            for k in range(1, down):
                for j in range(across):
                    carried[r + k, at + j] = text
            row += [text] * max(1, across)
        while (r, len(row)) in carried:
            row.append(carried[r, len(row)])
        rows.append(row)
        header.append(bool(cells) and all(local(c.tag) == "th" for c in cells))
    head = first(e, "thead")
    n = len(every(head, "tr", "row")) if head is not None else 0
    return rows, [h or i < n for i, h in enumerate(header)]


def parse_jats(content: bytes | str, name: str = "") -> list[dict]:
    root = root_of(content)
    out: list[dict] = []
    front = first(root, "article-meta")
    meta = front if front is not None else root
    if t := said(first(meta, "article-title")):
        out.append(heading(1, escape(t)))
    people = [" ".join(filter(None, (said(first(c, "given-names")), said(first(c, "surname"))))) or said(first(c, "collab")) for c in every(meta, "contrib") if c.get("contrib-type", "author") == "author"]
    if people := [p for p in people if p]:
        out.append(paragraph(escape(", ".join(people))))
    if places := [t for a in every(meta, "aff") if (t := said(a, ("label", "sup")))]:
        out.append(paragraph(escape("; ".join(places))))
    for a in every(meta, "abstract"):
        out.append(heading(2, escape(said(next((x for x in a if local(x.tag) == "title"), None)) or "Abstract")))
        _jats(a, 2, out, skip_title=True)
    for part in ("body", "back"):
        if (b := next((x for x in root if local(x.tag) == part), None)) is not None:
            _jats(b, 1, out)
    return out


def _jats(e: ET.Element, depth: int, out: list[dict], skip_title: bool = False) -> None:
    for x in e:
        tag = local(x.tag)
        if tag == "title":
            if not skip_title and (t := said(x)):
                out.append(heading(depth, escape(t)))
        elif tag in ("sec", "ack", "app", "app-group", "notes", "fn-group", "glossary"):
            if tag == "ack" and first(x, "title") is None:
                out.append(heading(depth + 1, "Acknowledgments"))
            _jats(x, depth + 1, out)
        elif tag == "p":
            _jats_paragraph(x, depth, out)
        elif tag == "list":
            for k, li in enumerate(c for c in x if local(c.tag) == "list-item"):
                if t := said(li, ("list", "label")):
                    out.append(item(escape(t), 0, x.get("list-type") == "order", k + 1, k == 0))
                for inner in (c for c in li if local(c.tag) == "list"):
                    out += [n | {"level": n["level"] + 1} for n in _collect(inner, depth)]
        elif tag in ("table-wrap", "table"):
            rows, head = table_rows(x)
            cap = first(x, "caption")
            label = said(first(x, "label"))
            if rows:
                out.append(table(rows, head, caption=escape(" ".join(filter(None, (label, said(cap))))) or None))
        elif tag in ("fig", "fig-group"):
            out.append(picture(escape(" ".join(filter(None, (said(first(x, "label")), said(first(x, "caption")))))) or None))
        elif tag == "disp-formula":
            tex = first(x, "tex-math")
            out.append(node("formula", said(tex) if tex is not None else said(x)))
        elif tag == "ref-list":
            out.append(heading(depth + 1, escape(said(next((c for c in x if local(c.tag) == "title"), None)) or "References")))
            for k, r in enumerate(c for c in x if local(c.tag) == "ref"):
                if t := said(r, ("label",)):
                    out.append(item(escape(t), 0, False, k + 1, k == 0))
        elif tag == "fn":
            if t := said(x, ("label",)):
                out.append(paragraph(escape(t)))
        elif tag in ("disp-quote", "boxed-text", "statement"):
            _jats(x, depth, out)
        elif tag == "preformat":
            out.append(node("code", "".join(x.itertext())))


def _collect(e: ET.Element, depth: int) -> list[dict]:
    holder = ET.Element("x")
    holder.append(e)
    out: list[dict] = []
    _jats(holder, depth, out)
    return out


def _jats_paragraph(p: ET.Element, depth: int, out: list[dict]) -> None:
    """Text is put out before the blocks inside the paragraph."""
    text: list[str] = [p.text or ""]

    def flush() -> None:
        if t := flat("".join(text)):
            out.append(paragraph(escape(t)))
        text.clear()

    for c in p:
        if local(c.tag) in ("list", "table-wrap", "fig", "disp-formula", "disp-quote", "boxed-text"):
            flush()
            holder = ET.Element("x")
            holder.append(c)
            _jats(holder, depth, out)
        elif local(c.tag) not in ("inline-formula", "supplementary-material"):
            text.append(said(c))
        text.append(c.tail or "")
    flush()


def parse_uspto(content: bytes | str, name: str = "") -> list[dict]:
    """Title, abstract, description and claims of the three generations of patent XML; record dumps as they are."""
    text = decode(content)
    if text.startswith("PATN"):
        return [node("text_dump", text)]
    root = root_of(content)
    out: list[dict] = []
    if t := said(first(root, "invention-title", "title-of-invention", "B540")):
        out.append(heading(1, escape(t)))

    def body(e: ET.Element) -> None:
        for x in e:
            tag = local(x.tag)
            if tag in ("heading", "H", "h"):
                if t := said(x):
                    level = x.get("level") or x.get("LVL") or "1"
                    out.append(heading(int(level) + 1 if level.isdigit() else 2, escape(t)))
            elif tag in ("p", "paragraph", "PARA", "para"):
                tables = every(x, "table", "TABLE")
                if t := said(x, ("table", "TABLE", "tables", "maths", "math")):
                    out.append(paragraph(escape(t)))
                for tb in tables:
                    rows, head = table_rows(tb)
                    if rows:
                        out.append(table(rows, head))
            elif tag in ("table", "TABLE"):
                rows, head = table_rows(x)
                if rows:
                    out.append(table(rows, head))
            else:
                body(x)

    for tags, title in ((("abstract", "subdoc-abstract", "SDOAB"), "Abstract"), (("description", "subdoc-description", "SDODE"), None), (("claims", "subdoc-claims", "SDOCL"), "Claims")):
        e = first(root, *tags)
        if e is None:
            continue
        if title:
            out.append(heading(2, title))
        if title == "Claims":
            for c in every(e, "claim", "CL"):
                if t := said(c):
                    out.append(paragraph(escape(t)))
        else:
            body(e)
    return out


def parse_xbrl(content: bytes | str, name: str = "") -> list[dict]:
    """Title facts, then text blocks as HTML, each text once and in order."""
    root = root_of(content)
    named: dict[str, str] = {}
    out: list[dict] = []
    seen: set[str] = set()
    for e in root.iter():
        tag = local(e.tag)
        if tag in ("DocumentType", "EntityRegistrantName", "DocumentPeriodEndDate") and (t := flat(e.text or "")):
            named[tag] = t
        elif tag.endswith("TextBlock") and (t := flat(e.text or "")) and t not in seen:
            seen.add(t)
            out += html.parse(t, furniture=False)
    title = " ".join(named[k] for k in ("DocumentType", "EntityRegistrantName", "DocumentPeriodEndDate") if k in named)
    return [heading(1, escape(title)), *out] if title else out


def parse_xml(content: bytes | str, name: str = "") -> list[dict]:
    """A known dialect, or the text of each element that holds some."""
    text = decode(content)
    head = text[:4000].lower()
    if "us-patent" in head or "patdoc" in head or "pap-v1" in head:
        return parse_uspto(content)
    if "<xbrl" in head or ":xbrl" in head:
        return parse_xbrl(content)
    if "jats" in head or re.search(r"<article[\s>]", head):
        return parse_jats(content)
    out = []
    for e in root_of(content).iter():
        own = flat(" ".join([e.text or "", *(c.tail or "" for c in e)]))
        if own:
            out.append(paragraph(escape(own)))
    return out
