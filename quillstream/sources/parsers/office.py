"""Office archives: OOXML text, slides and sheets, and OpenDocument."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from quillstream.sources.parsers.containers import Package, local
from quillstream.sources.parsers.nodes import Style, escape, flat, heading, item, join_runs, node, paragraph, picture, run_rows, table


def kids(e: ET.Element | None, *tags: str) -> list[ET.Element]:
    return [x for x in (e if e is not None else ()) if local(x.tag) in tags]


def first(e: ET.Element | None, *tags: str) -> ET.Element | None:
    return next((x for x in (e.iter() if e is not None else ()) if local(x.tag) in tags), None)


def attr(e: ET.Element | None, name: str, default: str | None = None) -> str | None:
    if e is None:
        return default
    return next((v for k, v in e.attrib.items() if local(k) == name), default)


def on(e: ET.Element | None, tag: str) -> bool:
    x = next(iter(kids(e, tag)), None)
    return x is not None and attr(x, "val", "1") not in ("0", "false", "none")


# Equations


NARY = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "⋃": r"\bigcup", "⋂": r"\bigcap"}
SYMBOLS = {"α": r"\alpha ", "β": r"\beta ", "γ": r"\gamma ", "δ": r"\delta ", "ε": r"\epsilon ", "θ": r"\theta ", "λ": r"\lambda ", "μ": r"\mu ", "π": r"\pi ", "σ": r"\sigma ", "φ": r"\phi ", "ω": r"\omega ", "≤": r"\leq ", "≥": r"\geq ", "≠": r"\neq ", "±": r"\pm ", "×": r"\times ", "∞": r"\infty ", "→": r"\rightarrow ", "∈": r"\in "}


def latex(e: ET.Element | None) -> str:
    """An OMML tree as LaTeX."""
    if e is None:
        return ""
    part = lambda x, tag: "".join(latex(c) for c in next(iter(kids(x, tag)), ()))
    tag = local(e.tag)
    if tag == "r":
        return "".join(SYMBOLS.get(c, c) for t in kids(e, "t") for c in t.text or "")
    if tag == "f":
        return rf"\frac{{{part(e, 'num')}}}{{{part(e, 'den')}}}"
    if tag == "sSup":
        return f"{part(e, 'e')}^{{{part(e, 'sup')}}}"
    if tag == "sSub":
        return f"{part(e, 'e')}_{{{part(e, 'sub')}}}"
    if tag == "sSubSup":
        return f"{part(e, 'e')}_{{{part(e, 'sub')}}}^{{{part(e, 'sup')}}}"
    if tag == "rad":
        deg = part(e, "deg")
        return rf"\sqrt[{deg}]{{{part(e, 'e')}}}" if deg else rf"\sqrt{{{part(e, 'e')}}}"
    if tag == "nary":
        sign = attr(first(e, "chr"), "val", "∫")
        low, high = part(e, "sub"), part(e, "sup")
        return NARY.get(sign, sign) + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f"{{{part(e, 'e')}}}"
    if tag == "d":
        a, b = attr(first(e, "begChr"), "val", "("), attr(first(e, "endChr"), "val", ")")
        return rf"\left{a or '.'}" + ",".join("".join(latex(c) for c in x) for x in kids(e, "e")) + rf"\right{b or '.'}"
    if tag == "func":
        return rf"\{part(e, 'fName').strip()}{{{part(e, 'e')}}}"
    if tag == "m":
        return r"\begin{matrix}" + r" \\ ".join(" & ".join("".join(latex(c) for c in x) for x in kids(r, "e")) for r in kids(e, "mr")) + r"\end{matrix}"
    if tag in ("acc", "bar"):
        return rf"\overline{{{part(e, 'e')}}}" if tag == "bar" else rf"\hat{{{part(e, 'e')}}}"
    return "".join(latex(c) for c in e if not local(c.tag).endswith("Pr"))


# Word


class Word:
    def __init__(self, content: bytes):
        self.p = Package(content)
        self.rels = self.p.relations("word/document.xml")
        self.styles: dict[str, tuple[str, str | None, ET.Element]] = {}
        root = self.p.xml("word/styles.xml")
        for s in kids(root, "style"):
            based = next(iter(kids(s, "basedOn")), None)
            self.styles[attr(s, "styleId", "")] = (attr(next(iter(kids(s, "name")), None), "val", "") or "", attr(based, "val"), s)
        self.formats: dict[tuple[str, int], tuple[str, str, int]] = {}
        num = self.p.xml("word/numbering.xml")
        kinds = {attr(a, "abstractNumId"): a for a in kids(num, "abstractNum")}
        for n in kids(num, "num"):
            a = kinds.get(attr(next(iter(kids(n, "abstractNumId")), None), "val"))
            for lv in kids(a, "lvl"):
                self.formats[attr(n, "numId", ""), int(attr(lv, "ilvl", "0"))] = (attr(next(iter(kids(lv, "numFmt")), None), "val", "bullet"), attr(next(iter(kids(lv, "lvlText")), None), "val", ""), int(attr(next(iter(kids(lv, "start")), None), "val", "1") or 1))
        self.counts: dict[tuple[str, int], int] = {}
        self.out: list[dict] = []
        self.listing: tuple[str, int] | None = None

    def chain(self, style: str | None) -> list[tuple[str, ET.Element]]:
        out, seen = [], set()
        while style in self.styles and style not in seen:
            seen.add(style)
            name, based, e = self.styles[style]
            out.append((name, e))
            style = based
        return out

    def runs(self, e: ET.Element, href: str | None = None) -> list[tuple[str, Style]]:
        out: list[tuple[str, Style]] = []
        for x in e:
            tag = local(x.tag)
            if tag == "r":
                pr = next(iter(kids(x, "rPr")), None)
                script = attr(next(iter(kids(pr, "vertAlign")), None), "val")
                s = Style(bold=on(pr, "b"), italic=on(pr, "i"), underline=on(pr, "u"), strike=on(pr, "strike"), script={"superscript": "sup", "subscript": "sub"}.get(script), href=href)
                text = "".join(c.text or "" if local(c.tag) == "t" else "\t" if local(c.tag) == "tab" else "\n" if local(c.tag) in ("br", "cr") else "" for c in x)
                if text:
                    if out and out[-1][1] == s:
                        out[-1] = (out[-1][0] + text, s)
                    else:
                        out.append((text, s))
            elif tag == "hyperlink":
                rel = self.rels.get(attr(x, "id") or "", (None, None))[1]
                out += self.runs(x, rel or href)
            elif tag == "oMath":
                out.append((f"${latex(x)}$", Style(code=False)))
            elif tag in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple", "oMathPara"):
                out += self.runs(x, href)
        return out

    @staticmethod
    def text(runs: list[tuple[str, Style]]) -> str:
        return join_runs([(flat(t), s) for t, s in runs if flat(t)])

    def body(self, e: ET.Element) -> None:
        for x in e:
            tag = local(x.tag)
            if tag == "p":
                self.paragraph(x)
            elif tag == "tbl":
                self.table(x)
            elif tag in ("sdt", "sdtContent", "ins", "customXml"):
                self.body(x)

    def number(self, num: str, level: int) -> int:
        fmt = self.formats.get((num, level), ("bullet", "", 1))
        n = self.counts.get((num, level), fmt[2] - 1) + 1
        self.counts[num, level] = n
        for k in [k for k in self.counts if k[0] == num and k[1] > level]:
            del self.counts[k]
        return n

    def paragraph(self, e: ET.Element) -> None:
        pr = next(iter(kids(e, "pPr")), None)
        names = self.chain(attr(next(iter(kids(pr, "pStyle")), None), "val"))
        for box in [x for x in e.iter() if local(x.tag) == "txbxContent"][:1]:
            self.body(box)
        for _ in [x for x in e.iter() if local(x.tag) == "blip"]:
            alt = first(e, "docPr")
            self.out.append(picture(flat(attr(alt, "descr", "") or "") or None))
        maths = [x for x in e.iter() if local(x.tag) == "oMath"]
        runs = self.runs(e)
        if maths and all(local(x.tag) in ("oMathPara", "oMath", "pPr") for x in e):
            self.out += [node("formula", latex(x)) for x in maths]
            return
        text = self.text(runs)
        mark = first(e, "checkBox", "checkbox")
        num = next((n for holder in (pr, *[next(iter(kids(s, "pPr")), None) for _, s in names]) for n in kids(holder, "numPr")), None)
        level = next((m for name, _ in names if (m := re.fullmatch(r"(?i)heading (\d)", name))), None)
        title = any(name.lower() == "title" for name, _ in names)
        if not text:
            return
        more = {"runs": run_rows(runs)}
        if mark is not None:
            self.out.append(node("checkbox", text, checked=on(mark, "checked") or on(mark, "default")))
        elif level or title:
            plain = escape(flat("".join(t for t, _ in runs)))
            if num is not None and level:
                depth, nid = int(attr(next(iter(kids(num, "ilvl")), None), "val", "0") or 0), attr(next(iter(kids(num, "numId")), None), "val", "0")
                if self.formats.get((nid, depth), ("bullet",))[0] != "bullet":
                    self.number(nid, depth)
                    plain = ".".join(str(self.counts.get((nid, k), 1)) for k in range(depth + 1)) + " " + plain
            self.out.append(heading(1 if title else int(level[1]), plain))
        elif num is not None and (nid := attr(next(iter(kids(num, "numId")), None), "val", "0")) != "0":
            depth = int(attr(next(iter(kids(num, "ilvl")), None), "val", "0") or 0)
            fmt, shape, _ = self.formats.get((nid, depth), ("bullet", "", 1))
            n = self.number(nid, depth)
            ordered = fmt != "bullet"
            fresh = not self.out or self.out[-1]["kind"] != "list_item"
            base = depth if fresh else min(self.base, depth)
            self.base = base
            simple = re.fullmatch(r"%\d[.)]", shape or "") is not None
            self.out.append(item(text, depth - base, ordered and simple, n, fresh, marker=None if simple or not ordered else shape, **more))
        else:
            self.out.append(paragraph(text, **more))

    base = 0

    def table(self, e: ET.Element) -> None:
        rows: list[list[str]] = []
        above: dict[int, str] = {}
        heads = []
        trs = kids(e, "tr")
        if len(trs) == 1 and len(kids(trs[0], "tc")) == 1:
            self.body(kids(trs[0], "tc")[0])
            return
        for tr in trs:
            row: list[str] = []
            for tc in kids(tr, "tc"):
                pr = next(iter(kids(tc, "tcPr")), None)
                span = int(attr(next(iter(kids(pr, "gridSpan")), None), "val", "1") or 1)
                merge = next(iter(kids(pr, "vMerge")), None)
                inner = Word.__new__(Word)
                inner.__dict__ = self.__dict__ | {"out": []}
                inner.body(tc)
                text = " ".join(filter(None, (n.get("text") or "" for n in inner.out))).replace("\n", " ")
                if merge is not None and attr(merge, "val", "continue") == "continue":
                    text = above.get(len(row), "")
                for k in range(span):
                    above[len(row)] = text
                    row.append(text)
            rows.append(row)
            heads.append(on(next(iter(kids(tr, "trPr")), None), "tblHeader"))
        if any(rows):
            self.out.append(table(rows, heads if any(heads) else None))


def parse_docx(content: bytes, name: str = "") -> list[dict]:
    w = Word(content)
    root = w.p.xml("word/document.xml")
    body = first(root, "body")
    if body is not None:
        w.body(body)
    for kind, layer in (("header", "furniture"), ("footer", "furniture"), ("comments", "notes")):
        for what, part in w.rels.values():
            if what == kind and (extra := w.p.xml(part)) is not None:
                before, w.out = w.out, []
                for c in kids(extra, "comment") if kind == "comments" else [extra]:
                    w.body(c)
                w.out = [*before, *[n | {"layer": layer} for n in w.out]]
    return w.out


# Slides


def _slide_text(p: ET.Element) -> str:
    runs = []
    for r in p:
        if local(r.tag) == "r":
            pr = next(iter(kids(r, "rPr")), None)
            if t := flat(next(iter(kids(r, "t")), ET.Element("t")).text or ""):
                runs.append((t, Style(bold=attr(pr, "b") == "1", italic=attr(pr, "i") == "1")))
        elif local(r.tag) == "br":
            runs.append(("\n", Style()))
    return join_runs(runs).replace("\n", " ")


def _shapes(tree: ET.Element, p: Package, rels: dict) -> list[dict]:
    out: list[dict] = []
    for sp in tree:
        tag = local(sp.tag)
        if tag == "grpSp":
            out += _shapes(sp, p, rels)
        elif tag == "pic":
            out.append(picture(flat(attr(first(sp, "cNvPr"), "descr", "") or "") or None))
        elif tag == "graphicFrame":
            if (tbl := first(sp, "tbl")) is not None:
                rows, above = [], {}
                for tr in kids(tbl, "tr"):
                    row = []
                    for tc in kids(tr, "tc"):
                        text = " ".join(filter(None, map(_slide_text, (x for x in tc.iter() if local(x.tag) == "p"))))
                        if attr(tc, "hMerge") == "1" and row:
                            text = row[-1]
                        if attr(tc, "vMerge") == "1":
                            text = above.get(len(row), "")
                        above[len(row)] = text
                        row.append(text)
                    rows.append(row)
                out.append(table(rows))
            elif first(sp, "chart") is not None:
                out.append(node("chart", caption=flat(attr(first(sp, "cNvPr"), "name", "") or "") or None))
        elif tag == "sp":
            ph = first(sp, "ph")
            kind = attr(ph, "type", "body" if ph is not None else "")
            body = first(sp, "txBody")
            fresh = True
            for para in kids(body, "p"):
                text = _slide_text(para)
                if not text:
                    continue
                pr = next(iter(kids(para, "pPr")), None)
                if kind in ("title", "ctrTitle"):
                    out.append(heading(1, text))
                elif kind == "subTitle" or kind in ("dt", "ftr", "sldNum"):
                    out.append(paragraph(text) if kind == "subTitle" else paragraph(text, layer="furniture"))
                elif not kids(pr, "buNone") and (kids(pr, "buAutoNum", "buChar") or ph is not None and kind in ("body", "")):
                    number = bool(kids(pr, "buAutoNum"))
                    n = out[-1]["number"] + 1 if not fresh and out and out[-1]["kind"] == "list_item" else 1
                    out.append(item(text, 0, number, n, fresh))
                    fresh = False
                else:
                    out.append(paragraph(text))
    return out


def parse_pptx(content: bytes, name: str = "") -> list[dict]:
    p = Package(content)
    rels = p.relations("ppt/presentation.xml")
    order = [rels[i][1] for s in (x for x in p.xml("ppt/presentation.xml").iter() if local(x.tag) == "sldId") if (i := next((v for k, v in s.attrib.items() if k.endswith("}id")), None)) in rels]
    out: list[dict] = []
    for k, part in enumerate(order):
        if k:
            out.append(node("page_break"))
        slide, own = p.xml(part), p.relations(part)
        out += _shapes(first(slide, "spTree"), p, own)
        for what, target in own.values():
            if what == "notesSlide" and (notes := p.xml(target)) is not None:
                for sp in (x for x in notes.iter() if local(x.tag) == "sp"):
                    if attr(first(sp, "ph"), "type") == "body":
                        out += [paragraph(t, layer="notes") for para in sp.iter() if local(para.tag) == "p" and (t := _slide_text(para))]
            elif what == "comments" and (said := p.xml(target)) is not None:
                out += [paragraph(escape(flat(t.text or "")), layer="notes") for t in said.iter() if local(t.tag) == "text" and flat(t.text or "")]
    return out


# Sheets

DATE_FORMATS = frozenset([*range(14, 23), 45, 46, 47])


def column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def cell_range(ref: str) -> tuple[int, int, int, int]:
    """A1:B2, or one cell, to (row, column, last row, last column) from 0."""
    a, _, b = ref.replace("$", "").rpartition("!")[2].partition(":")
    b = b or a
    row = lambda r: int(re.search(r"\d+", r)[0]) - 1
    return row(a), column(a), row(b), column(b)


def show_number(text: str, date: bool) -> str:
    try:
        v = float(text)
    except ValueError:
        return text
    if date:
        d = datetime(1899, 12, 30) + timedelta(days=v)
        return d.strftime("%Y-%m-%d %H:%M:%S") if v % 1 else d.strftime("%Y-%m-%d")
    return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)


def regions(filled: set[tuple[int, int]]) -> list[set[tuple[int, int]]]:
    """Groups of cells that touch at a side, from the top left."""
    out, left = [], set(filled)
    for start in sorted(filled):
        if start not in left:
            continue
        left.discard(start)
        group, stack = {start}, [start]
        while stack:
            r, c = stack.pop()
            for x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if x in left:
                    left.discard(x)
                    group.add(x)
                    stack.append(x)
        out.append(group)
    return out


def sheet_tables(values: dict[tuple[int, int], str], merged: list[tuple[int, int, int, int]]) -> list[dict]:
    """A table for each region; a lone cell is a paragraph, merged cells repeat their text."""
    values = dict(values)
    for r, c, rr, cc in merged:
        if (r, c) in values:
            for i in range(r, min(rr, r + 1000) + 1):
                for j in range(c, min(cc, c + 1000) + 1):
                    values[i, j] = values[r, c]
    out = []
    for group in regions(set(values)):
        top, left = min(r for r, _ in group), min(c for _, c in group)
        bottom, right = max(r for r, _ in group), max(c for _, c in group)
        if len(group) == 1:
            out.append(paragraph(escape(values[top, left])))
        else:
            out.append(table([[escape(values.get((r, c), "")) if (r, c) in group else "" for c in range(left, right + 1)] for r in range(top, bottom + 1)]))
    return out


def parse_xlsx(content: bytes, name: str = "") -> list[dict]:
    p = Package(content)
    shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in kids(p.xml("xl/sharedStrings.xml"), "si")]
    styles = p.xml("xl/styles.xml")
    custom = {int(attr(f, "numFmtId", "0")): attr(f, "formatCode", "") for f in (styles.iter() if styles is not None else ()) if local(f.tag) == "numFmt"}
    dates = []
    for xf in kids(first(styles, "cellXfs"), "xf"):
        i = int(attr(xf, "numFmtId", "0"))
        dates.append(i in DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(i, "")), re.I)))
    rels = p.relations("xl/workbook.xml")
    out: list[dict] = []
    for k, sheet in enumerate(x for x in p.xml("xl/workbook.xml").iter() if local(x.tag) == "sheet"):
        part = rels.get(next((v for a, v in sheet.attrib.items() if a.endswith("}id")), ""), ("", ""))[1]
        root = p.xml(part)
        if root is None:
            continue
        values: dict[tuple[int, int], str] = {}
        for c in (x for x in root.iter() if local(x.tag) == "c"):
            kind, v = attr(c, "t", "n"), next(iter(kids(c, "v")), None)
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter() if local(t.tag) == "t")
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                text = shared[int(v.text)]
            elif kind == "b":
                text = "True" if v.text == "1" else "False"
            elif kind in ("str", "e"):
                text = v.text
            else:
                s = int(attr(c, "s", "0"))
                text = show_number(v.text, s < len(dates) and dates[s])
            if text.strip() and (ref := attr(c, "r")):
                values[int(re.search(r"\d+", ref)[0]) - 1, column(ref)] = text.strip()
        merged = [cell_range(attr(m, "ref")) for m in root.iter() if local(m.tag) == "mergeCell"]
        layer = "invisible" if attr(sheet, "state") in ("hidden", "veryHidden") else None
        if k:
            out.append(node("page_break"))
        found = sheet_tables(values, merged)
        notes = []
        for what, target in p.relations(part).values():
            if what == "comments" and (said := p.xml(target)) is not None:
                notes += [paragraph(escape(t), layer="notes") for c in said.iter() if local(c.tag) == "comment" and (t := flat("".join(x.text or "" for x in c.iter() if local(x.tag) == "t")))]
            elif what == "drawing" and (d := p.xml(target)) is not None:
                for e in d.iter():
                    if local(e.tag) == "pic":
                        found.append(picture(flat(attr(first(e, "cNvPr"), "descr", "") or "") or None))
                for rel, chart in p.relations(target).values():
                    if rel == "chart" and (c := p.xml(chart)) is not None:
                        found.append(_chart(c))
        out += [n | {"layer": layer} if layer else n for n in found] + notes
    return out


def _chart(root: ET.Element) -> dict:
    """A chart's series as a grid, from its caches."""
    plot = first(root, "plotArea")
    kind = next((local(x.tag) for x in (plot if plot is not None else ()) if local(x.tag).endswith("Chart")), "chart")
    points = lambda e: [flat(v.text or "") for pt in (e.iter() if e is not None else ()) if local(pt.tag) == "pt" for v in kids(pt, "v")]
    series = [x for x in root.iter() if local(x.tag) == "ser"]
    names = [(points(next(iter(kids(s, "tx")), None)) or [f"Series {i + 1}"])[0] for i, s in enumerate(series)]
    cats = points(next(iter(kids(series[0], "cat", "xVal")), None)) if series else []
    cols = [points(next(iter(kids(s, "val", "yVal")), None)) for s in series]
    n = max([len(cats), *map(len, cols)], default=0)
    rows = [["", *names], *[[cats[i] if i < len(cats) else "", *[c[i] if i < len(c) else "" for c in cols]] for i in range(n)]]
    title = first(root, "title")
    cap = flat("".join(t.text or "" for t in (title.iter() if title is not None else ()) if local(t.tag) == "t"))
    return node("chart", marker=re.sub(r"(?<=[a-z])(?=[A-Z])", "_", kind).lower(), table=table(rows)["table"], caption=cap or None)


# OpenDocument


class Open:
    def __init__(self, content: bytes):
        self.p = Package(content)
        self.styles: dict[str, ET.Element] = {}
        for part in ("styles.xml", "content.xml"):
            for s in (x for x in (self.p.xml(part) if part in self.p.names else ET.Element("x")).iter() if local(x.tag) == "style"):
                self.styles[attr(s, "name", "")] = s
        self.out: list[dict] = []

    def chain(self, name: str | None) -> list[ET.Element]:
        """A style and its parents; cycles end."""
        out = []
        while name in self.styles and self.styles[name] not in out:
            out.append(self.styles[name])
            name = attr(self.styles[name], "parent-style-name")
        return out

    def style(self, name: str | None, s: Style) -> Style:
        for e in reversed(self.chain(name)):
            pr = next(iter(kids(e, "text-properties")), None)
            weight = attr(pr, "font-weight")
            if weight:
                s = s.with_(bold=weight == "bold" or weight.isdigit() and int(weight) >= 600)
            if attr(pr, "font-style"):
                s = s.with_(italic=attr(pr, "font-style") in ("italic", "oblique"))
            if attr(pr, "text-line-through-style"):
                s = s.with_(strike=attr(pr, "text-line-through-style") != "none")
            if attr(pr, "text-underline-style"):
                s = s.with_(underline=attr(pr, "text-underline-style") != "none")
        return s

    def runs(self, e: ET.Element, s: Style) -> list[tuple[str, Style]]:
        out = [(e.text or "", s)]
        for x in e:
            tag = local(x.tag)
            if tag == "span":
                out += self.runs(x, self.style(attr(x, "style-name"), s))
            elif tag == "a":
                out += self.runs(x, s.with_(href=attr(x, "href")))
            elif tag == "s":
                out.append((" " * int(attr(x, "c", "1")), s))
            elif tag == "tab":
                out.append((" ", s))
            elif tag == "line-break":
                out.append(("\n", s))
            elif tag not in ("note", "annotation", "frame"):
                out += self.runs(x, s)
            out.append((x.tail or "", s))
        joined: list[tuple[str, Style]] = []
        for t, st in out:
            if joined and joined[-1][1] == st and "\n" not in (t, joined[-1][0]):
                joined[-1] = (joined[-1][0] + t, st)
            elif t:
                joined.append((t, st))
        return joined

    def text(self, e: ET.Element) -> str:
        return join_runs([(t if t == "\n" else flat(t), s) for t, s in self.runs(e, Style()) if t == "\n" or flat(t)])

    def frames(self, e: ET.Element) -> None:
        for f in (x for x in e.iter() if local(x.tag) == "frame"):
            if first(f, "image") is not None and first(f, "text-box") is None:
                self.out.append(picture(flat("".join((first(f, "title") if first(f, "title") is not None else ET.Element("x")).itertext())) or None))

    def body(self, e: ET.Element, level: int = 0) -> None:
        for x in e:
            tag = local(x.tag)
            if tag == "h":
                if t := self.text(x):
                    self.out.append(heading(int(attr(x, "outline-level", "1")) + 1, t.replace("\n", " ")))
            elif tag == "p":
                names = [attr(s, "name", "") for s in self.chain(attr(x, "style-name"))]
                self.frames(x)
                if t := self.text(x):
                    self.out.append(heading(1, t) if "Title" in names else heading(2, t) if "Subtitle" in names else paragraph(t))
            elif tag == "list":
                self.list(x, level)
            elif tag == "table":
                self.table(x)
            elif tag == "frame":
                box = first(x, "text-box")
                if box is not None:
                    self.body(box, level)
                elif (tbl := first(x, "table")) is not None:
                    self.table(tbl)
                else:
                    self.out.append(picture(None))
            elif tag in ("section", "text-box", "page", "g", "custom-shape", "presentation", "text", "table-of-content", "index-body"):
                self.body(x, level)

    def list(self, e: ET.Element, level: int) -> None:
        kind = next((s for s in self.lists if attr(s, "name") == attr(e, "style-name")), None)
        ordered = bool(kids(kind, "list-level-style-number"))
        for n, li in enumerate(kids(e, "list-item", "list-header")):
            for x in li:
                if local(x.tag) == "list":
                    self.list(x, level + 1)
                elif local(x.tag) in ("p", "h") and (t := self.text(x)):
                    self.out.append(item(t.replace("\n", " "), level, ordered, n + 1, n == 0))

    @property
    def lists(self) -> list[ET.Element]:
        return [x for part in ("content.xml", "styles.xml") for x in (self.p.xml(part) if part in self.p.names else ET.Element("x")).iter() if local(x.tag) == "list-style"]

    def grid(self, e: ET.Element) -> tuple[dict[tuple[int, int], str], list[tuple[int, int, int, int]]]:
        values, merged, r = {}, [], 0
        for tr in (x for x in e.iter() if local(x.tag) == "table-row"):
            c = 0
            again = int(attr(tr, "number-rows-repeated", "1"))
            row = {}
            for tc in kids(tr, "table-cell", "covered-table-cell"):
                n = int(attr(tc, "number-columns-repeated", "1"))
                text = " ".join(filter(None, (self.text(p) for p in tc.iter() if local(p.tag) in ("p", "h")))).replace("\n", " ")
                across, down = int(attr(tc, "number-columns-spanned", "1")), int(attr(tc, "number-rows-spanned", "1"))
                if text:
                    row |= {c + k: text for k in range(min(n, 1000))}
                    if across > 1 or down > 1:
                        merged.append((r, c, r + down - 1, c + across - 1))
                c += n
            for k in range(min(again, 1000) if row else 0):
                values |= {(r + k, j): t for j, t in row.items()}
            r += again
        return values, merged

    def table(self, e: ET.Element) -> None:
        values, merged = self.grid(e)
        for r, c, rr, cc in merged:
            for i in range(r, rr + 1):
                for j in range(c, cc + 1):
                    values[i, j] = values[r, c]
        if values:
            h, w = max(r for r, _ in values) + 1, max(c for _, c in values) + 1
            self.out.append(table([[values.get((i, j), "") for j in range(w)] for i in range(h)]))


def parse_odt(content: bytes, name: str = "") -> list[dict]:
    o = Open(content)
    o.body(first(o.p.xml("content.xml"), "text"))
    return o.out


def parse_odp(content: bytes, name: str = "") -> list[dict]:
    o = Open(content)
    for k, page in enumerate(x for x in o.p.xml("content.xml").iter() if local(x.tag) == "page"):
        if k:
            o.out.append(node("page_break"))
        for f in page:
            kind = next((v for a, v in f.attrib.items() if local(a) == "class"), "")
            before = len(o.out)
            holder = ET.Element("x")
            holder.append(f)
            if local(f.tag) != "notes":
                o.body(holder)
            if kind == "title":
                o.out[before:] = [heading(1, n["text"]) if n["kind"] == "paragraph" else n for n in o.out[before:]]
    return o.out


def parse_ods(content: bytes, name: str = "") -> list[dict]:
    o = Open(content)
    sheets = [x for x in o.p.xml("content.xml").iter() if local(x.tag) == "table"]
    out: list[dict] = []
    for k, s in enumerate(sheets):
        if k:
            out.append(node("page_break"))
        out += sheet_tables(*o.grid(s))
    return out
