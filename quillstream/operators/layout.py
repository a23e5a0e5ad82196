"""Page geometry: overlap resolution, reading order, cell assignment, text assembly, table structure.

Pure functions over one page's boxes, applied by page with applyInPandas; pages are the unit, never a document.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame

from quillstream.runtime import ship

THRESHOLDS = {"page_header": 0.45, "page_footer": 0.45, "title": 0.45, "section_header": 0.45, "code": 0.45, "checkbox_selected": 0.45, "checkbox_unselected": 0.45, "form": 0.45, "key_value_region": 0.45, "document_index": 0.45}
CONTAINED, SAME, PICTURE_TABLE, INSIDE, ORPHAN, MEMBER = 0.7, 0.5, 0.8, 0.8, 0.2, 0.5
DILATION, EPS = 0.15, 1e-3
WRAPPERS = ("picture", "table", "form", "key_value_region", "document_index")


@dataclass(frozen=True)
class Box:
    l: float  # noqa: E741
    t: float
    r: float
    b: float
    label: str = "text"
    score: float = 1.0
    text: str = ""
    ix: int = 0

    @property
    def area(self) -> float:
        return max(self.r - self.l, 0) * max(self.b - self.t, 0)


def intersection(a: Box, b: Box) -> float:
    return max(min(a.r, b.r) - max(a.l, b.l), 0) * max(min(a.b, b.b) - max(a.t, b.t), 0)


def iou(a: Box, b: Box) -> float:
    i = intersection(a, b)
    u = a.area + b.area - i
    return i / u if u > 0 else 0.0


def share(inner: Box, outer: Box) -> float:
    return intersection(inner, outer) / inner.area if inner.area > 0 else 0.0


def union(boxes: list[Box]) -> tuple[float, float, float, float]:
    return min(b.l for b in boxes), min(b.t for b in boxes), max(b.r for b in boxes), max(b.b for b in boxes)


def confident(boxes: list[Box]) -> list[Box]:
    return [b for b in boxes if b.score >= THRESHOLDS.get(b.label, 0.5)]


def suppress(boxes: list[Box]) -> list[Box]:
    """Greedy: the best first; one that lies in or equals one already kept goes."""
    kept: list[Box] = []
    for b in sorted(boxes, key=lambda x: (-x.score, -x.area, x.ix)):
        if not any(share(b, k) > CONTAINED or iou(b, k) > SAME for k in kept):
            kept.append(b)
    return kept


def resolve(boxes: list[Box], cells: list[Box] = ()) -> list[Box]:
    """Wrappers and regular regions apart, then pictures that are tables, regions inside wrappers, and orphan cells."""
    wrappers = suppress([b for b in boxes if b.label in WRAPPERS])
    regular = suppress([b for b in boxes if b.label not in WRAPPERS])
    wrappers = [w for w in wrappers if w.label != "picture" or not any(o.label != "picture" and iou(w, o) > PICTURE_TABLE for o in wrappers)]
    regular = [b for b in regular if not any(w.label in ("picture", "table") and share(b, w) > INSIDE for w in wrappers)]
    out = wrappers + regular
    orphans = [c for c in cells if c.text.strip() and all(share(c, r) <= ORPHAN for r in out)]
    return out + [Box(c.l, c.t, c.r, c.b, "text", 1.0, c.text, 10_000 + c.ix) for c in orphans]


def reading_order(boxes: list[Box], width: float) -> list[Box]:
    """Boxes by columns: edges go from a box to the nearest ones below that it overlaps sideways; depth first from the top.

    Boxes are widened towards a neighbour above by part of the page width, if that makes none overlap, so that lines
    that are a bit apart stay in one column. Headers come first and footers last.
    """
    head = [b for b in boxes if b.label == "page_header"]
    foot = [b for b in boxes if b.label == "page_footer"]
    main = [b for b in boxes if b not in head and b not in foot]
    beside = lambda a, b: min(a[1], b[1]) - max(a[0], b[0]) > EPS
    spans = []
    for b in main:
        above = [o for o in main if o.b <= b.t + EPS and beside((o.l, o.r), (b.l, b.r))]
        l, r = b.l, b.r  # noqa: E741
        if above:
            near = max(above, key=lambda o: o.b)
            grown = (min(b.l, near.l), max(b.r, near.r))
            if b.l - grown[0] <= DILATION * width and grown[1] - b.r <= DILATION * width and not any(o is not b and o.t < b.b - EPS and o.b > b.t + EPS and beside((o.l, o.r), grown) for o in main):
                l, r = grown  # noqa: E741
        spans.append((l, r))
    follow: list[list[int]] = [[] for _ in main]
    before = [0] * len(main)
    for i, b in enumerate(main):
        ups = [j for j, o in enumerate(main) if j != i and o.b <= b.t + EPS and beside(spans[j], spans[i])]
        for j in ups:  # unless another one lies between them
            if not any(k != j and main[j].b <= main[k].t + EPS and main[k].b <= b.t + EPS and beside(spans[k], spans[j]) and beside(spans[k], spans[i]) for k in ups):
                follow[j].append(i)
                before[i] += 1
    place = lambda i: (main[i].l, main[i].t, main[i].ix)
    order: list[int] = []
    stack = sorted((i for i in range(len(main)) if not before[i]), key=lambda i: (main[i].t, main[i].l), reverse=True)
    stack.sort(key=place, reverse=True)
    while stack:
        i = stack.pop()
        order.append(i)
        ready = []
        for j in follow[i]:
            before[j] -= 1
            if not before[j]:
                ready.append(j)
        stack += sorted(ready, key=place, reverse=True)
    line = lambda b: (b.t, b.l)
    return sorted(head, key=line) + [main[i] for i in order] + sorted(foot, key=line)


def members(region: Box, cells: list[Box]) -> list[Box]:
    """Cells of which more than half lies in the region, in their own order."""
    return sorted((c for c in cells if share(c, region) > MEMBER), key=lambda c: c.ix)


QUOTES = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "⁄": "/", "•": "·"})


def clean(text: str) -> str:
    """Words broken at line ends are joined, quotes made plain, white space single."""
    text = re.sub(r"(\w)[-­]\n(?=[a-zß-ÿ])", r"\1", text)
    text = repair_ligatures(text.replace("\n", " "))
    return " ".join(text.translate(QUOTES).split())


def repair_ligatures(text: str) -> str:
    """Lam and alef that a text layer gave in the wrong order."""
    return re.sub("([اأإآ])ل(?=[ء-ي])(?<=[ء-ي].)", r"ل\1", text)


def region_text(region: Box, cells: list[Box]) -> str:
    """Lines by vertical overlap, cells from left to right."""
    lines: list[list[Box]] = []
    for c in sorted(members(region, cells), key=lambda c: (c.t, c.l)):
        if lines and c.t < (lines[-1][0].t + lines[-1][0].b) / 2:
            lines[-1].append(c)
        else:
            lines.append([c])
    return clean("\n".join(" ".join(c.text for c in sorted(line, key=lambda c: c.l)) for line in lines))


def pair_captions(boxes: list[Box]) -> dict[int, int]:
    """Picture or table to its caption: the nearest below within three lines that overlaps sideways, each used once; for code above."""
    captions = [b for b in boxes if b.label == "caption"]
    height = median([c.b - c.t for c in captions]) if captions else 0
    out: dict[int, int] = {}
    for p in sorted((b for b in boxes if b.label in ("picture", "table", "code")), key=lambda b: (b.t, b.l)):
        gap = (lambda c, p=p: p.t - c.b) if p.label == "code" else (lambda c, p=p: c.t - p.b)
        near = [c for c in captions if c.ix not in out.values() and -height < gap(c) < 3 * height and min(p.r, c.r) > max(p.l, c.l)]
        if near:
            out[p.ix] = min(near, key=lambda c: (gap(c), c.ix)).ix
    return out


def geometric_table(cells: list[Box]) -> list[list[str]]:
    """Rows by vertical overlap, columns by gaps between all cells."""
    if not cells:
        return []
    rows: list[list[Box]] = []
    for c in sorted(cells, key=lambda c: (c.t + c.b, c.l)):
        if rows and (c.t + c.b) / 2 < max(x.b for x in rows[-1]):
            rows[-1].append(c)
        else:
            rows.append([c])
    edges: list[tuple[float, float]] = []
    for c in sorted(cells, key=lambda c: c.l):
        if edges and c.l < edges[-1][1]:
            edges[-1] = (edges[-1][0], max(edges[-1][1], c.r))
        else:
            edges.append((c.l, c.r))
    column = lambda c: next(k for k, (a, b) in enumerate(edges) if a <= c.l <= b)
    out = []
    for r in rows:
        line = [""] * len(edges)
        for c in sorted(r, key=lambda c: c.l):
            line[column(c)] = " ".join(filter(None, (line[column(c)], c.text)))
        out.append(line)
    return out


def otsl_cells(tokens: list[str]) -> list[dict]:
    """Structure tokens to cells with spans: (row, col, row_span, col_span, header)."""
    rows: list[list[str]] = [[]]
    for t in tokens:
        if t == "nl":
            rows.append([])
        else:
            rows[-1].append(t)
    rows = [r for r in rows if r]
    at = lambda i, j: rows[i][j] if 0 <= i < len(rows) and j < len(rows[i]) else ""
    out = []
    for i, r in enumerate(rows):
        for j, t in enumerate(r):
            if t in ("lcel", "ucel", "xcel"):
                continue
            w = 1
            while at(i, j + w) == "lcel":
                w += 1
            h = 1
            while at(i + h, j) == "ucel":
                h += 1
            out.append({"row": i, "col": j, "row_span": h, "col_span": w, "header": t in ("ched", "rhed", "srow")})
    return out


def match_cells(cells: list[Box], words: list[Box]) -> dict[int, list[int]]:
    """Each word to the predicted cell that holds most of it; words in none go to the nearest row and column."""
    out: dict[int, list[int]] = {c.ix: [] for c in cells}
    for w in words:
        best = max(cells, key=lambda c: (intersection(c, w), -c.ix), default=None)
        if best is None:
            continue
        if intersection(best, w) <= 0:
            mid = lambda b: ((b.l + b.r) / 2, (b.t + b.b) / 2)
            x, y = mid(w)
            best = min(cells, key=lambda c: (abs(mid(c)[1] - y), abs(mid(c)[0] - x), c.ix))
        out[best.ix].append(w.ix)
    return out


def column_positions(cells: list[Box], column: Callable[[Box], int]) -> dict[int, float]:
    """The median left edge of each column."""
    found: dict[int, list[float]] = {}
    for c in cells:
        found.setdefault(column(c), []).append(c.l)
    return {k: median(v) for k, v in found.items()}


LABEL_KINDS = {"title": "heading", "section_header": "heading", "list_item": "list_item", "code": "code", "formula": "formula", "table": "table", "document_index": "table", "picture": "picture", "checkbox_selected": "checkbox", "checkbox_unselected": "checkbox", "page_header": "page_furniture", "page_footer": "page_furniture"}
LANGUAGE = re.compile(r"^\s*(python|java|javascript|c\+\+|c#|rust|go|sql|bash|json|yaml|xml|html)\s*$", re.I)


def assemble(regions: list[Box], cells: list[Box], width: float, height: float) -> list[dict]:
    """A page's nodes in reading order: captions join their pictures, language labels their code, locations on a 512 grid."""
    order = reading_order(resolve(confident(regions), cells), width)
    captions = pair_captions(order)
    by_ix = {b.ix: b for b in order}
    order = [b for b in order if b.ix not in captions.values()]
    said = {b.ix: b.text or region_text(b, cells) for b in order}
    languages = {after.ix: b for b, after in zip(order, order[1:]) if after.label == "code" and b.label == "text" and LANGUAGE.match(said[b.ix])}
    labels = {b.ix for b in languages.values()}
    grid = lambda v, size: int(min(max(int(512 * v / size + 0.5), 0), 511))
    out: list[dict] = []
    for b in order:
        if b.ix in labels:
            continue
        text, kind = said[b.ix], LABEL_KINDS.get(b.label, "paragraph")
        n = {"kind": kind, "text": text, "location": [grid(b.l, width), grid(b.t, height), grid(b.r, width), grid(b.b, height)]}
        if kind == "heading":
            n["level"] = 1 if b.label == "title" else 2
        elif kind == "list_item":
            n |= {"text": re.sub(r"^[·•\-*]\s*", "", text), "level": 0, "ordered": False, "number": 1, "first_in_list": not out or out[-1]["kind"] != "list_item"}
        elif kind == "checkbox":
            n["checked"] = b.label == "checkbox_selected"
        elif kind == "table":
            rows = geometric_table(members(b, cells))
            n = {"kind": "table", "location": n["location"], "table": {"rows": rows, "header_rows": [i == 0 for i in range(len(rows))], "col_continues": None, "row_continues": None}}
        elif kind == "picture":
            n["text"] = None
        elif kind == "page_furniture":
            n |= {"layer": "furniture", "marker": b.label}
        if b.ix in languages:
            n["language"] = said[languages[b.ix].ix].strip().lower()
        if b.ix in captions:
            c = by_ix[captions[b.ix]]
            n["caption"] = region_text(c, cells) or c.text
        if n.get("text") or kind in ("picture", "table"):
            out.append(n)
    return out


SKIPPED = ("picture", "page_furniture", "page_break")


def merge_continuations(nodes: list[dict]) -> list[dict]:
    """A paragraph that ends in a letter or hyphen goes on in the next one that starts in lower case, pictures and furniture between aside."""
    out: list[dict] = []
    for n in nodes:
        if n["kind"] == "paragraph" and n.get("text") and n["text"][0].islower():
            back = next((i for i in range(len(out) - 1, -1, -1) if out[i]["kind"] not in SKIPPED), None)
            if back is not None and out[back]["kind"] == "paragraph" and re.search(r"[A-Za-zÀ-ɏ,-]$", out[back]["text"] or ""):
                had = out[back]["text"]
                joined = had[:-1] + n["text"] if had.endswith("-") else f"{had} {n['text']}"
                out[back] = out[back] | {"text": joined}
                continue
        out.append(n)
    return out


@dataclass
class StreamingAssembler:
    """Pages in order; what a later page could still rewrite is held back."""

    held: list[dict] = field(default_factory=list)

    def push(self, page: list[dict]) -> list[dict]:
        self.held = merge_continuations([*self.held, *page])
        last = next((i for i in range(len(self.held) - 1, -1, -1) if self.held[i]["kind"] == "paragraph"), None)
        if last is None:
            ready, self.held = self.held, []
        else:
            ready, self.held = self.held[:last], self.held[last:]
        return ready

    def finish(self) -> list[dict]:
        ready, self.held = self.held, []
        return ready


def lines_of_glyphs(glyphs: list[Box], gap: float = 1.5) -> list[Box]:
    """Glyph boxes to line boxes: same baseline, and no gap wider than gap times the glyph width; spaces where words part."""
    out: list[list[Box]] = []
    for g in sorted(glyphs, key=lambda g: (round((g.t + g.b) / 2), g.l)):
        wide = max(g.r - g.l, 1e-6)
        if out and abs((out[-1][-1].t + out[-1][-1].b) - (g.t + g.b)) < (g.b - g.t) and 0 <= g.l - out[-1][-1].r + wide < (gap + 1) * wide:
            out[-1].append(g)
        else:
            out.append([g])
    lines = []
    for k, line in enumerate(out):
        text = line[0].text
        for a, b in zip(line, line[1:]):
            text += (" " if b.l - a.r > 0.3 * (b.r - b.l) else "") + b.text
        lines.append(Box(*union(line), text=text, ix=k))
    return lines


def words_of_lines(lines: list[Box]) -> list[Box]:
    """Lines to word boxes, widths in proportion to characters."""
    out = []
    for line in lines:
        unit = (line.r - line.l) / max(len(line.text), 1)
        for m in re.finditer(r"\S+", line.text):
            out.append(Box(line.l + m.start() * unit, line.t, line.l + m.end() * unit, line.b, text=m[0], ix=len(out)))
    return out


# By page


def _boxes(pdf: pd.DataFrame) -> list[Box]:
    return [Box(float(r.l), float(r.t), float(r.r), float(r.b), str(getattr(r, "label", "text")), float(getattr(r, "score", 1.0)), str(getattr(r, "text", "") or ""), int(r.ix)) for r in pdf.itertuples()]


def order_pages(boxes: DataFrame, by: tuple[str, ...] = ("doc_id", "page"), width: float = 612.0) -> DataFrame:
    """(doc, page, ix, label, score, l, t, r, b) to (doc, page, ix, rank): overlaps resolved, in reading order."""
    ship(boxes.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = reading_order(resolve(confident(_boxes(pdf))), width)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(order) for c in by}, "ix": [b.ix for b in order], "rank": range(len(order))})

    kinds = dict(boxes.dtypes)
    return boxes.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "ix long, rank long"]))
