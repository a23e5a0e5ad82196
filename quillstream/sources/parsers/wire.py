"""The engine's JSON and XML exchange forms, read back to nodes."""

from __future__ import annotations

import json
from xml.etree import ElementTree as ET

from quillstream.sources.parsers.containers import Package, local
from quillstream.sources.parsers.nodes import decode, flat, heading, item, node, paragraph, picture, table


def parse_json(content: bytes | str, name: str = "") -> list[dict]:
    """Walks the body's references: #/kind/index into the arrays of texts, tables, pictures, groups and fields."""
    doc = json.loads(decode(content))
    out: list[dict] = []
    seen: set[str] = set()

    def get(ref: str) -> dict | None:
        parts = ref.lstrip("#/").split("/")
        try:
            x = doc
            for p in parts:
                x = x[int(p)] if isinstance(x, list) else x[p]
            return x
        except (KeyError, IndexError, ValueError, TypeError):
            return None

    def captions(x: dict) -> str | None:
        said = [c.get("text", "") for r in x.get("captions", ()) if (c := get(r.get("$ref", "")))]
        seen.update(r.get("$ref", "") for r in x.get("captions", ()))
        return " ".join(filter(None, said)) or None

    def visit(ref: str, level: int, counter: list[int] | None) -> None:
        x = get(ref)
        if x is None or ref in seen:
            return
        seen.add(ref)
        if x.get("content_layer", "body") not in ("body", None):
            return
        label, text = x.get("label", ""), x.get("text") or ""
        children = [c.get("$ref", "") for c in x.get("children", ())]
        if ref.startswith("#/tables"):
            data = x.get("data", {})
            cells = data.get("grid") or []
            rows = [[flat(c.get("text", "")) for c in r] for r in cells]
            said = captions(x)
            if rows:
                out.append(table(rows, [all(c.get("column_header") for c in r) for r in cells], caption=said))
        elif ref.startswith("#/pictures"):
            out.append(picture(captions(x)))
        elif ref.startswith(("#/key_value_items", "#/form_items")):
            cells = x.get("graph", {}).get("cells", [])
            out.append(node("field_region", fields=[{"marker": None, "key": c.get("text") if c.get("label") == "key" else None, "value": c.get("text") if c.get("label") != "key" else None} for c in cells]))
        elif ref.startswith("#/groups"):
            if label == "inline":
                parts = [c for r in children if (c := get(r))]
                seen.update(children)
                if t := " ".join(filter(None, (c.get("text", "") for c in parts))):
                    out.append(paragraph(t))
                return
            count = [0] if label in ("list", "ordered_list") else counter
            inside = level + 1 if label in ("list", "ordered_list") and counter is not None else level
            for c in children:
                visit(c, inside, count)
            return
        elif label == "title":
            out.append(heading(1, text))
        elif label == "section_header":
            out.append(heading(int(x.get("level", 1)) + 1, text))
        elif label == "list_item":
            counter = counter if counter is not None else [0]
            counter[0] += 1
            out.append(item(text, level, bool(x.get("enumerated")), counter[0], counter[0] == 1, marker=x.get("marker")))
        elif label == "code":
            out.append(node("code", text, language=x.get("code_language")))
        elif label == "formula":
            out.append(node("formula", text))
        elif label.startswith("checkbox"):
            out.append(node("checkbox", text, checked=label == "checkbox_selected"))
        elif text:
            out.append(paragraph(text))
        for c in children:
            visit(c, level + 1 if label == "list_item" else level, [0] if label == "list_item" else None)

    for c in doc.get("body", {}).get("children", ()):
        visit(c.get("$ref", ""), 0, None)
    return out


def parse_xml_document(content: bytes | str, name: str = "") -> list[dict]:
    """What serialize.to_xml writes, or an archive of it."""
    if isinstance(content, bytes) and content[:2] == b"PK":
        content = Package(content).read("document.xml") or b"<document/>"
    root = ET.fromstring(decode(content))
    out: list[dict] = []

    def said(e: ET.Element) -> str:
        return flat("".join(e.itertext()))

    def one(e: ET.Element, layer: str | None, level: int) -> None:
        tag = local(e.tag)
        more = {"layer": e.get("layer") or layer}
        if e.get("location"):
            more["location"] = [int(x) for x in e.get("location").split()]
        if tag == "heading":
            out.append(heading(int(e.get("level", "1")), said(e), **more))
        elif tag == "list":
            ordered = e.get("class") == "ordered"
            for k, x in enumerate(c for c in e if local(c.tag) in ("item", "list")):
                if local(x.tag) == "list":
                    one(x, layer, level + 1)
                else:
                    out.append(item(said(x), level, ordered, k + int(e.get("start", "1")), k == 0, **more))
        elif tag == "table":
            rows = [r for r in e.iter() if local(r.tag) == "row"]
            cap = next((said(c) for c in e if local(c.tag) == "caption"), None)
            if rows:
                out.append(table([[said(c) for c in r] for r in rows], [r.get("header") == "true" for r in rows], caption=cap, **more))
        elif tag == "picture":
            out.append(picture(said(e) or None, **more))
        elif tag == "code":
            out.append(node("code", "".join(e.itertext()), language=e.get("language"), **more))
        elif tag == "formula":
            out.append(node("formula", "".join(e.itertext()), **more))
        elif tag == "checkbox":
            out.append(node("checkbox", said(e), checked=e.get("checked") == "true", **more))
        elif tag == "fields":
            out.append(node("field_region", fields=[{"marker": f.get("marker"), "key": f.get("key"), "value": f.text} for f in e], **more))
        elif tag == "page_break":
            out.append(node("page_break"))
        elif tag == "furniture":
            for x in e:
                one(x, "furniture", level)
        elif t := said(e):
            out.append(paragraph(t, **more))

    for e in root:
        one(e, None, 0)
    return out
