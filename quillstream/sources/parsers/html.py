"""HTML: a tolerant tree builder, then a walk of blocks and inline runs."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from quillstream.sources.parsers.nodes import Style, decode, flat, heading, item, join_runs, mark_leading_furniture, node, paragraph, picture, run_rows, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style head title noscript template svg".split())
FORMATTING = frozenset("a b strong i em u ins s strike del code tt small big font sub sup kbd samp mark".split())
BLOCKS = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul legend iframe caption".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption".split())
#: A start tag ends open ones of these kinds, up to a barrier.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"caption", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
DEPTH = 2000


class Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def find_all(self, *tags: str):
        stack = [*reversed(self.children)]
        while stack:
            x = stack.pop()
            if isinstance(x, Element):
                if x.tag in tags:
                    yield x
                stack += reversed(x.children)

    def find(self, *tags: str) -> Element | None:
        return next(self.find_all(*tags), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                stack += reversed(x.children)
        return "".join(out)


class Builder(HTMLParser):
    """Void elements, implied ends, and formatting that is left open and goes on in the next block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#document", {})
        self.stack = [self.root]
        self.active: list[Element] = []
        self.deepest = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and any(x.tag == tag for x in self.stack):
            return
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "li", "button"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag not in BLOCKS:
            self._reopen()
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(e)
        if tag in VOID:
            return
        self.stack.append(e)
        self.deepest = max(self.deepest, len(self.stack))
        if tag in FORMATTING:
            self.active.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tags: set[str], barrier: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if t in tags:
                del self.stack[i:]
                if not any(x.tag in tags for x in self.stack[1:]) or tags == {"p"}:
                    return
            elif t in barrier:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in FORMATTING:
            for i in range(len(self.active) - 1, -1, -1):
                if self.active[i].tag == tag:
                    gone = self.active.pop(i)
                    if gone in self.stack:
                        del self.stack[self.stack.index(gone) :]
                    return
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
        if tag == "p":
            self.stack[-1].children.append(Element("p", {}))

    def _reopen(self) -> None:
        for k, e in enumerate(self.active):
            if e not in self.stack:
                again = Element(e.tag, e.attrs)
                self.stack[-1].children.append(again)
                self.stack.append(again)
                self.active[k] = again

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._reopen()
        self.stack[-1].children.append(data)


def build(markup: str) -> tuple[Element, int]:
    b = Builder()
    b.feed(markup)
    b.close()
    return b.root, b.deepest


def hidden(e: Element) -> bool:
    style = e.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in e.attrs or "display:none" in style or "visibility:hidden" in style


def styled(tag: str, attrs: dict[str, str], s: Style) -> Style:
    match tag:
        case "b" | "strong":
            return s.with_(bold=True)
        case "i" | "em" | "var":
            return s.with_(italic=True)
        case "u" | "ins":
            return s.with_(underline=True)
        case "s" | "strike" | "del":
            return s.with_(strike=True)
        case "code" | "kbd" | "samp" | "tt":
            return s.with_(code=True)
        case "sub" | "sup":
            return s.with_(script=tag)
        case "a":
            href = attrs.get("href", "")
            return s.with_(href=re.sub(r"^(https?://[^/?#]+)$", r"\1/", href)) if href else s
    return s


class Walker:
    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.layer: str | None = None

    def add(self, n: dict) -> None:
        self.nodes.append(n | {"layer": self.layer} if self.layer else n)

    # inline

    def runs(self, e: Element | list, s: Style = Style(), blocks: bool = False) -> list[tuple[str, Style]]:
        """Text runs; blocks: whether text of nested blocks counts too."""
        out: list[tuple[str, Style]] = []
        for x in e.children if isinstance(e, Element) else e:
            if isinstance(x, str):
                if t := flat(x):
                    out.append((t, s))
            elif x.tag == "br":
                out.append(("\n", s))
            elif x.tag in SKIPPED or hidden(x) or x.tag == "img":
                continue
            elif x.tag not in BLOCKS or blocks:
                out += self.runs(x, styled(x.tag, x.attrs, s), blocks)
        return out

    def inline(self, runs: list[tuple[str, Style]], make=paragraph, **more) -> None:
        while runs and runs[-1][0] == "\n":
            runs.pop()
        if text := join_runs(runs):
            self.add(make(text, runs=run_rows(runs), **more))

    def images(self, e: Element) -> None:
        for img in e.find_all("img"):
            self.add(picture(flat(img.attrs.get("alt", "")) or None))

    # blocks

    def walk(self, e: Element, level: int = 0) -> None:
        loose: list = []
        for x in [*e.children, None]:
            if isinstance(x, Element) and (x.tag in SKIPPED or hidden(x)):
                continue
            block = isinstance(x, Element) and (x.tag in BLOCKS or x.tag in ("img", "input", "select", "textarea", "label", "button") or x.tag not in ("br",) and x.find(*BLOCKS, "img") is not None)
            if x is None or block:
                if loose:
                    self.inline(self.runs(loose))
                    loose = []
                if x is not None:
                    self.block(x, level)
            else:
                loose.append(x)

    def block(self, e: Element, level: int) -> None:
        tag = e.tag
        if re.fullmatch("h[1-6]", tag):
            self.inline(self.runs(e, blocks=True), lambda t, **kw: heading(int(tag[1]), t.replace("\n", " "), **kw))
            self.images(e)
        elif tag == "p":
            inner = [c for c in e.children if not isinstance(c, str) or c.strip()]
            if len(inner) == 1 and isinstance(inner[0], Element) and inner[0].tag in ("code", "kbd", "samp"):
                self.add(node("code", flat(inner[0].text())))
            else:
                self.walk_paragraph(e)
        elif tag == "pre":
            self.pre(e)
        elif tag in ("ul", "ol", "menu"):
            self.list(e, level)
        elif tag == "dl":
            self.definitions(e, level)
        elif tag == "table":
            self.table(e)
        elif tag == "figure":
            if img := e.find("img"):
                cap = e.find("figcaption")
                self.add(picture(flat(cap.text()) if cap else flat(img.attrs.get("alt", "")) or None))
        elif tag == "img":
            self.add(picture(flat(e.attrs.get("alt", "")) or None))
        elif tag == "input":
            self.input(e, "")
        elif tag == "label":
            box = e.find("input")
            if box is not None:
                self.input(box, flat(e.text()))
            else:
                self.inline(self.runs(e, blocks=True))
        elif tag in ("hr", "iframe"):
            pass
        elif tag == "footer":
            before, self.layer = self.layer, "furniture"
            self.walk(e, level)
            self.layer = before
        elif tag == "a" and e.find("img") is not None and not flat(e.text()):
            self.images(e)
        else:
            self.form_region(e) or self.walk(e, level)

    def walk_paragraph(self, e: Element) -> None:
        if e.find(*BLOCKS) is not None:
            self.walk(e)
            return
        self.inline(self.runs(e))
        self.images(e)

    def pre(self, e: Element) -> None:
        code = e.find("code")
        kinds = " ".join(x.attrs.get("class", "") for x in (e, *([code] if code else [])))
        found = re.search(r"(?:language|lang)-([\w+#.-]+)", kinds)
        self.add(node("code", e.text().strip("\n"), language=found[1] if found else None))

    def input(self, e: Element, label: str) -> None:
        kind = e.attrs.get("type", "text").lower()
        if kind == "hidden":
            return
        if kind in ("checkbox", "radio"):
            if label:
                self.add(node("checkbox", label, checked="checked" in e.attrs))
            return
        if text := next((t for k in ("value", "placeholder", "name") if (t := e.attrs.get(k, "").strip())), None):
            self.add(paragraph(text))

    def form_region(self, e: Element) -> bool:
        """Elements with ids keyN and valueN (and markerN) make a field region."""
        if "form_region" not in e.attrs.get("class", ""):
            return False
        found: dict[str, dict] = {}
        for x in e.find_all(*BLOCKS, "span", "label", "input", "b", "strong", "em"):
            if m := re.fullmatch(r"(key|value|marker)(\d+)(?:_.*)?", x.attrs.get("id", "")):
                found.setdefault(m[2], {"marker": None, "key": None, "value": None})[m[1]] = flat(x.text()) or x.attrs.get("value")
        if not found:
            return False
        self.add(node("field_region", fields=[found[k] for k in sorted(found, key=int)]))
        return True

    def list(self, e: Element, level: int) -> None:
        ordered = e.tag == "ol"
        start = e.attrs.get("start", "1")
        number, first = int(start) if re.fullmatch(r"-?\d+", start) else 1, True
        for li in e.children:
            if not isinstance(li, Element) or hidden(li) or li.tag in SKIPPED:
                continue
            if li.tag in ("ul", "ol", "menu"):
                self.list(li, level + 1)
                continue
            nested = [x for x in li.children if isinstance(x, Element) and x.tag in ("ul", "ol", "menu", "table", "pre", "dl")]
            own = [x for x in li.children if x not in nested]
            holder = Element("li", {})
            holder.children = own
            runs = self.runs(holder, blocks=True)
            box = holder.find("input")
            text = join_runs(runs).replace("\n", " ")
            if box is not None and box.attrs.get("type") in ("checkbox", "radio") and text:
                self.add(node("checkbox", text, checked="checked" in box.attrs))
            elif text or nested:
                alone = runs[0][1].href if runs and len({s.href for _, s in runs}) == 1 else None
                if text:
                    self.add(item(text, level, ordered, number, first, runs=run_rows(runs), href=alone))
                    first = False
            number += 1
            for x in nested:
                self.block(x, level + 1)

    def definitions(self, e: Element, level: int) -> None:
        first = True
        for x in e.find_all("dt", "dd"):
            if text := join_runs(self.runs(x, Style(bold=True) if x.tag == "dt" else Style(), blocks=True)).replace("\n", " "):
                self.add(item(text, level + (x.tag == "dd"), first=first))
                first = False

    def table(self, e: Element) -> None:
        rows, header = [], []
        carried: dict[tuple[int, int], str] = {}
        cap = e.find("caption")
        own: list[Element] = []
        stack = [*reversed(e.children)]
        while stack:
            x = stack.pop()
            if isinstance(x, Element):
                if x.tag == "tr":
                    own.append(x)
                elif x.tag in ("thead", "tbody", "tfoot"):
                    stack += reversed(x.children)
        for r, tr in enumerate(own):
            row: list[str] = []
            cells = [x for x in tr.children if isinstance(x, Element) and x.tag in ("td", "th") and not hidden(x)]
            for cell in cells:
                while (r, len(row)) in carried:
                    row.append(carried[r, len(row)])
                text = join_runs(self.runs(cell, blocks=True)).replace("\n", " ")
                span = lambda k, cell=cell: max(1, min(int(v) if (v := cell.attrs.get(k, "1")).isdigit() else 1, 1000))
                down, across = span("rowspan"), span("colspan")
                at = len(row)
                for k in range(1, down):
                    for c in range(across):
                        carried[r + k, at + c] = text
                row += [text] * across
            while (r, len(row)) in carried:
                row.append(carried[r, len(row)])
            rows.append(row)
            header.append(bool(cells) and all(c.tag == "th" for c in cells))
        if any(rows):
            self.add(table(rows, header if any(header) else None, caption=flat(cap.text()) if cap else None))


def parse(content: bytes | str, name: str = "", furniture: bool = True) -> list[dict]:
    """The title is a furniture heading; what precedes the body's first heading is furniture too."""
    root, deepest = build(decode(content))
    w = Walker()
    title = root.find("title")
    head = [heading(1, flat(title.text()), layer="furniture")] if title is not None and flat(title.text()) else []
    if deepest > DEPTH:
        return [*head, paragraph(flat(root.text()))]
    body = root.find("body") or root.find("html") or root
    w.walk(body)
    return [*head, *(mark_leading_furniture(w.nodes) if furniture else w.nodes)]


def links(content: bytes | str) -> list[tuple[str, str]]:
    """(text, href) of anchors, in order."""
    root, _ = build(decode(content))
    return [(flat(a.text()), a.attrs["href"]) for a in root.find_all("a") if a.attrs.get("href")]
