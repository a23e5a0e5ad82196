"""Sinks: a document's ordered nodes to Markdown, JSON, XML and archives. Plain functions over lists of nodes."""

from __future__ import annotations

import base64
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape as xml_escape
from xml.sax.saxutils import quoteattr

from quillstream.sources.parsers.nodes import unescape

IMAGE = "<!-- image -->"
MISSING = "<!-- missing-text -->"
NUMBER = re.compile(r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?([eE][+-]?\d+)?$|^[+-]?(\.\d+|inf|nan)$", re.I)
STRICT = ((" .", "."), (" ,", ","), (" ;", ";"), (" :", ":"), (" )", ")"), ("( ", "("), (" ]", "]"), ("[ ", "["))


def tighten(s: str) -> str:
    for a, b in STRICT:
        s = s.replace(a, b)
    return s


def humanize(label: str) -> str:
    s = label.replace("_", " ")
    return s[:1].upper() + s[1:]


def body(nodes: list[dict]) -> list[dict]:
    """What serializers show: no other layer, no page furniture, nothing meant for one sink only."""
    return [n for n in nodes if not n.get("layer") and n["kind"] not in ("page_furniture", "page_break") and not n.get("sink_only")]


def table_grid(table: dict, compact: bool = False) -> str:
    """Columns at least two wider than their heads; columns of numbers to the right. Compact: no padding."""
    cell = lambda s: (s or "").replace("\n", " ").replace("|", "&#124;")
    rows = [[cell(c) for c in r] for r in table["rows"]]
    if not rows:
        return ""
    if compact:
        return "\n".join(["| " + " | ".join(rows[0]) + " |", "| " + " | ".join("-" for _ in rows[0]) + " |", *("| " + " | ".join(r) + " |" for r in rows[1:])])
    wide = [max(len(rows[0][j]) + 2, *(len(r[j]) for r in rows)) for j in range(len(rows[0]))]
    right = [len(rows) > 1 and all(NUMBER.match(r[j].strip()) for r in rows[1:] if r[j].strip()) and any(r[j].strip() for r in rows[1:]) for j in range(len(wide))]
    line = lambda r: "| " + " | ".join(c.rjust(w) if k else c.ljust(w) for c, w, k in zip(r, wide, right)) + " |"
    rule = "|" + "|".join("-" * (w + 2) for w in wide) + "|"
    return "\n".join([line(rows[0]), rule, *map(line, rows[1:])])


def image_mark(n: dict, mode: str, number: int) -> str:
    img = n.get("image")
    if mode == "embedded" and img and img.get("data"):
        return f"![Image](data:{img['mimetype']};base64,{base64.b64encode(img['data']).decode()})"
    if mode == "referenced" and img and img.get("data"):
        return f"![Image](artifacts/image_{number:06d}.{img['mimetype'].rsplit('/', 1)[-1]})"
    return IMAGE


def list_line(n: dict, strict: bool = False) -> str:
    mark = f"{n.get('number') or 1}." if n.get("ordered") else "-"
    text = n.get("text") or ""
    if n.get("marker") and not n.get("ordered") and re.match(r"[\w(]", n["marker"]):
        text = f"{n['marker']} {text}"
    return "    " * (n.get("level") or 0) + f"{mark} {tighten(text) if strict else text}"


def block(n: dict, strict: bool = False, compact: bool = False, images: str = "placeholder", number: int = 0) -> str:
    """One node as Markdown; empty for nothing."""
    text = tighten(n.get("text") or "") if strict else n.get("text") or ""
    match n["kind"]:
        case "heading":
            return f"{'#' * min(max(n.get('level') or 1, 1), 6)} {text}"
        case "checkbox":
            return f"- [{'x' if n.get('checked') else ' '}] {text}"
        case "list_item":
            return list_line(n, strict)
        case "code":
            return f"```{(n.get('language') or '') if strict else ''}\n{n.get('text') or ''}\n```"
        case "formula":
            return f"$${n.get('text') or ''}$$" if n.get("text") else "<!-- formula-not-decoded -->"
        case "table":
            return "\n\n".join(filter(None, (n.get("caption"), table_grid(n["table"], compact))))
        case "picture":
            return "\n\n".join(filter(None, (n.get("caption"), image_mark(n, images, number))))
        case "chart":
            return "\n\n".join(filter(None, (n.get("caption"), IMAGE, humanize(n["marker"]) if n.get("marker") else None, table_grid(n["table"], compact) if n.get("table") else None)))
        case "field_region":
            return "\n\n".join([MISSING, *[" ".join(filter(None, (f.get("marker"), f.get("key"), f.get("value")))) for f in n.get("fields") or []]])
    return text


def markdown_blocks(nodes: list[dict], **how) -> Iterator[str]:
    """Blocks one at a time; a run of list items is one block."""
    run: list[str] = []
    pictures = 0
    for n in body(nodes):
        if n["kind"] in ("list_item", "checkbox"):
            if run and n.get("first_in_list") and not n.get("level") and n["kind"] == "list_item":
                yield "\n".join(run)
                run = []
            run.append(block(n, **how))
            continue
        if run:
            yield "\n".join(run)
            run = []
        b = block(n, number=pictures, **how)
        pictures += n["kind"] == "picture"
        if b:
            yield b
    if run:
        yield "\n".join(run)


def to_markdown(nodes: list[dict], *, strict: bool = False, compact: bool = False, images: str = "placeholder") -> str:
    return "\n\n".join(markdown_blocks(nodes, strict=strict, compact=compact, images=images))


def image_files(nodes: list[dict]) -> list[tuple[str, bytes]]:
    """What the referenced image mode points at."""
    found = [n for n in body(nodes) if n["kind"] == "picture"]
    return [(f"artifacts/image_{k:06d}.{n['image']['mimetype'].rsplit('/', 1)[-1]}", n["image"]["data"]) for k, n in enumerate(found) if (n.get("image") or {}).get("data")]


def recover_links(markdown: str, links: list[tuple[str, str]]) -> str:
    """Anchors that a text layer lost, in order: each text's next plain occurrence becomes a link."""
    at = 0
    for text, href in links:
        found = re.compile(rf"(?<![\w\[]){re.escape(text)}(?!\w)").search(markdown, at) if text else None
        if found is None:
            continue
        i = found.start()
        made = f"[{text}]({href})"
        markdown = markdown[:i] + made + markdown[i + len(text) :]
        at = i + len(made)
    return markdown


# JSON

OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def name_hash(s: str) -> int:
    h = OFFSET
    for b in s.encode():
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def to_json(nodes: list[dict], name: str = "", mimetype: str = "text/html") -> str:
    """The exchange form: arrays of texts, tables, pictures, groups and fields, and a body that refers to them in order."""
    doc: dict = {"schema_name": "Document", "version": "1.10.0", "name": name, "origin": {"mimetype": mimetype, "binary_hash": name_hash(name), "filename": name}}
    arrays: dict[str, list] = {k: [] for k in ("groups", "texts", "pictures", "tables", "key_value_items", "form_items")}
    root = {"self_ref": "#/body", "children": [], "content_layer": "body", "name": "_root_", "label": "unspecified"}

    def put(kind: str, parent: dict, **x) -> dict:
        e = {"self_ref": f"#/{kind}/{len(arrays[kind])}", "parent": {"$ref": parent["self_ref"]}, "children": [], **x}
        arrays[kind].append(e)
        parent["children"].append({"$ref": e["self_ref"]})
        return e

    stack: list[tuple[int, dict]] = []  # open lists by level
    for n in nodes:
        kind, layer = n["kind"], n.get("layer") or "body"
        said = unescape(n.get("text") or "")
        text = lambda label, parent=root, **x: put("texts", parent, content_layer=layer, label=label, prov=[], orig=said, text=said, **x)  # noqa: B023, E731
        if kind != "list_item":
            stack.clear()
        if kind == "heading":
            text("title") if n.get("level") == 1 else text("section_header", level=max(1, (n.get("level") or 2) - 1))
        elif kind == "list_item":
            level = n.get("level") or 0
            while stack and (stack[-1][0] > level or stack[-1][0] == level and n.get("first_in_list")):
                stack.pop()
            if not stack or stack[-1][0] < level:
                above = arrays["texts"][-1] if stack and arrays["texts"] else root
                stack.append((level, put("groups", above, content_layer=layer, name="list", label="ordered_list" if n.get("ordered") else "list")))
            text("list_item", stack[-1][1], enumerated=bool(n.get("ordered")), marker=n.get("marker") or (f"{n.get('number')}." if n.get("ordered") else "-"))
        elif kind == "code":
            text("code", code_language=n.get("language") or "unknown")
        elif kind == "formula":
            text("formula")
        elif kind == "checkbox":
            text("checkbox_selected" if n.get("checked") else "checkbox_unselected")
        elif kind == "table":
            rows = n["table"]["rows"]
            t = put("tables", root, content_layer=layer, label="table", prov=[], captions=[])
            cells = [[{"row_span": 1, "col_span": 1, "start_row_offset_idx": i, "end_row_offset_idx": i + 1, "start_col_offset_idx": j, "end_col_offset_idx": j + 1, "text": unescape(c or ""), "column_header": i == 0, "row_header": False} for j, c in enumerate(r)] for i, r in enumerate(rows)]
            t["data"] = {"table_cells": [c for r in cells for c in r], "num_rows": len(rows), "num_cols": len(rows[0]) if rows else 0, "grid": cells}
            _caption(n, t, put)
        elif kind in ("picture", "chart"):
            p = put("pictures", root, content_layer=layer, label=kind, prov=[], captions=[])
            _caption(n, p, put)
            if (n.get("image") or {}).get("data"):
                i = n["image"]
                p["image"] = {"mimetype": i["mimetype"], "size": {"width": i["width"], "height": i["height"]}, "uri": f"data:{i['mimetype']};base64,{base64.b64encode(i['data']).decode()}"}
        elif kind == "field_region":
            cells = [{"label": k, "cell_id": 2 * i + (k == "value"), "text": f[k]} for i, f in enumerate(n.get("fields") or []) for k in ("key", "value") if f.get(k)]
            put("key_value_items", root, content_layer=layer, label="key_value_region", prov=[], graph={"cells": cells, "links": []})
        elif kind != "page_break" and said:
            text({"page_furniture": "page_footer"}.get(kind, "text"))
    return json.dumps(doc | {"furniture": {"self_ref": "#/furniture", "children": [], "content_layer": "furniture", "name": "_root_", "label": "unspecified"}, "body": root, **arrays, "pages": {}}, ensure_ascii=False, indent=2)


def _caption(n: dict, e: dict, put) -> None:
    if n.get("caption"):
        c = put("texts", e, content_layer="body", label="caption", prov=[], orig=n["caption"], text=unescape(n["caption"]))
        e["captions"].append({"$ref": c["self_ref"]})


# XML


def to_xml(nodes: list[dict]) -> str:
    """The engine's XML: lists nest, tables keep their header rows, furniture is kept and marked."""
    out = ["<document>"]
    depth: list[bool] = []

    def close(to: int) -> None:
        while len(depth) > to:
            depth.pop()
            out.append("</list>")

    for n in nodes:
        more = (f" layer={quoteattr(n['layer'])}" if n.get("layer") else "") + (f' location="{" ".join(map(str, n["location"]))}"' if n.get("location") else "")
        text = xml_escape(unescape(n.get("text") or ""))
        if n["kind"] == "list_item":
            level = n.get("level") or 0
            close(level + 1)
            if n.get("first_in_list") and len(depth) == level + 1:
                close(level)
            while len(depth) <= level:
                depth.append(bool(n.get("ordered")))
                out.append(f'<list class="{"ordered" if n.get("ordered") else "unordered"}"' + (f' start="{n["number"]}"' if n.get("ordered") and n.get("number") not in (None, 1) else "") + ">")
            out.append(f"<item{more}>{text}</item>")
            continue
        close(0)
        match n["kind"]:
            case "heading":
                out.append(f'<heading level="{n.get("level") or 1}"{more}>{text}</heading>')
            case "table" | "chart" if n.get("table"):
                t = n["table"]
                cap = f"<caption>{xml_escape(unescape(n['caption']))}</caption>" if n.get("caption") else ""
                rows = "".join(f'<row{" header=" + quoteattr("true") if h else ""}>' + "".join(f"<cell>{xml_escape(unescape(c or ''))}</cell>" for c in r) + "</row>" for r, h in zip(t["rows"], t["header_rows"]))
                out.append(f"<table{more}>{cap}{rows}</table>")
            case "picture" | "chart":
                out.append(f"<picture{more}>{xml_escape(unescape(n.get('caption') or ''))}</picture>")
            case "code":
                language = f" language={quoteattr(n['language'])}" if n.get("language") else ""
                out.append(f"<code{language}{more}>{xml_escape(n.get('text') or '')}</code>")
            case "formula":
                out.append(f"<formula{more}>{xml_escape(n.get('text') or '')}</formula>")
            case "checkbox":
                out.append(f'<checkbox checked="{str(bool(n.get("checked"))).lower()}"{more}>{text}</checkbox>')
            case "field_region":
                inner = "".join("<field" + "".join(f" {k}={quoteattr(f[k])}" for k in ("marker", "key") if f.get(k)) + f">{xml_escape(f.get('value') or '')}</field>" for f in n.get("fields") or [])
                out.append(f"<fields{more}>{inner}</fields>")
            case "page_break":
                out.append("<page_break/>")
            case _:
                if text:
                    out.append(f"<paragraph{more}>{text}</paragraph>")
    close(0)
    return "".join([*out, "</document>"])


def to_archive(nodes: list[dict]) -> bytes:
    """The XML and its images in one ZIP, byte for byte the same on each run."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, data in (("document.xml", to_xml(nodes).encode()), *image_files(nodes)):
            z.writestr(zipfile.ZipInfo(path), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()
