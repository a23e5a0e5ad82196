"""Parsers: bytes to ordered nodes. parse(format, content, name) picks one by format."""

from __future__ import annotations

from collections.abc import Callable

from quillstream.sources.parsers import binary, containers, html, lines, markdown, office, pdf, tags, wire, xmldocs

PARSERS: dict[str, Callable[[bytes, str], list[dict]]] = {
    "markdown": markdown.parse_file, "html": html.parse, "csv": lines.parse_csv, "asciidoc": lines.parse_asciidoc, "webvtt": lines.parse_webvtt, "latex": lines.parse_latex, "email": containers.parse_email, "mhtml": containers.parse_mhtml,
    "epub": containers.parse_epub, "mets_gbs": containers.parse_mets, "docx": office.parse_docx, "pptx": office.parse_pptx, "xlsx": office.parse_xlsx, "odt": office.parse_odt, "odp": office.parse_odp, "ods": office.parse_ods, "jats": xmldocs.parse_jats,
    "uspto": xmldocs.parse_uspto, "xbrl": xmldocs.parse_xbrl, "xml": xmldocs.parse_xml, "tags": tags.parse, "json_document": wire.parse_json, "xml_document": wire.parse_xml_document, "doc": binary.parse_doc, "xls": binary.parse_xls, "ppt": binary.parse_ppt, "pdf": pdf.parse,
}


def parse(fmt: str, content: bytes, name: str = "") -> list[dict]:
    try:
        parser = PARSERS[fmt]
    except KeyError:
        raise ValueError(f"no parser for format {fmt!r}") from None
    return parser(content, name)
