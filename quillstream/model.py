"""Schemas of documents, nodes and chunks, and the formats that the engine routes."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


STR, INT, LONG, DBL, BOOL, BIN = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.BinaryType()

RUN = _s(("text", STR), ("bold", BOOL), ("italic", BOOL), ("underline", BOOL), ("strike", BOOL), ("script", STR), ("code", BOOL), ("formula", BOOL), ("href", STR))
FIELD = _s(("marker", STR), ("key", STR), ("value", STR))
TABLE = _s(("rows", T.ArrayType(T.ArrayType(STR))), ("header_rows", T.ArrayType(BOOL)), ("col_continues", T.ArrayType(T.ArrayType(BOOL))), ("row_continues", T.ArrayType(T.ArrayType(BOOL))))
IMAGE = _s(("mimetype", STR), ("width", INT), ("height", INT), ("data", BIN))

#: One row of the unified document model. Wrappers are columns: layer (null: body), location, group_path, sink_only.
NODE = _s(
    ("kind", STR), ("level", INT), ("text", STR), ("ordered", BOOL), ("number", LONG), ("first_in_list", BOOL), ("marker", STR), ("href", STR), ("layer", STR),
    ("language", STR), ("checked", BOOL), ("caption", STR), ("table", TABLE), ("fields", T.ArrayType(FIELD)), ("runs", T.ArrayType(RUN)), ("image", IMAGE),
    ("location", T.ArrayType(INT)), ("group_path", T.ArrayType(STR)), ("sink_only", BOOL),
)

SOURCE = _s(("name", STR), ("format", STR), ("content", BIN), ("path", STR), ("base_url", STR))
DOC_ITEM = _s(("self_ref", STR), ("kind", STR), ("text", STR))
CHUNK = _s(("text", STR), ("headings", T.ArrayType(STR)), ("doc_items", T.ArrayType(DOC_ITEM)))
STORED_DOCUMENT = _s(("id", STR), ("source_uri", STR), ("title", STR), ("hash", STR), ("metadata", STR), ("created_at", STR))
STORED_CHUNK = _s(("id", STR), ("doc_id", STR), ("ordinal", LONG), ("text", STR), ("token_count", LONG), ("metadata", STR), ("embedding", T.ArrayType(T.FloatType())))

KINDS = ("heading", "paragraph", "checkbox", "list_item", "code", "table", "picture", "formula", "chart", "field_region", "inline_group", "page_furniture", "page_break", "text_dump")
LAYERS = ("furniture", "notes", "invisible")
LABELS = ("caption", "checkbox_selected", "checkbox_unselected", "code", "document_index", "footnote", "formula", "list_item", "page_footer", "page_header", "paragraph", "picture", "reference", "section_header", "table", "text", "title")

#: extension to format
FORMATS = {
    "md": "markdown", "markdown": "markdown", "txt": "markdown", "text": "markdown", "qmd": "markdown", "rmd": "markdown", "html": "html", "htm": "html", "xhtml": "html", "csv": "csv",
    "adoc": "asciidoc", "asciidoc": "asciidoc", "asc": "asciidoc", "docx": "docx", "dotx": "docx", "docm": "docx", "dotm": "docx", "pptx": "pptx", "potx": "pptx", "ppsx": "pptx", "pptm": "pptx",
    "xlsx": "xlsx", "xlsm": "xlsx", "doc": "doc", "xls": "xls", "ppt": "ppt", "odt": "odt", "ott": "odt", "ods": "ods", "ots": "ods", "odp": "odp", "otp": "odp", "epub": "epub", "eml": "email",
    "mht": "mhtml", "mhtml": "mhtml", "vtt": "webvtt", "nxml": "jats", "xml": "xml", "xbrl": "xbrl", "tex": "latex", "latex": "latex", "json": "json_document", "dtg": "tags", "pdf": "pdf",
    "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "bmp": "image", "webp": "image", "wav": "audio", "mp3": "audio", "m4a": "audio", "aac": "audio", "ogg": "audio", "flac": "audio",
    "mp4": "video", "avi": "video", "mov": "video", "gz": "mets_gbs",
}

CONTENT_TYPES = {
    "text/html": "html", "application/xhtml+xml": "html", "text/markdown": "markdown", "text/plain": "markdown", "text/csv": "csv", "application/json": "json_document", "message/rfc822": "email", "multipart/related": "mhtml",
    "text/vtt": "webvtt", "application/pdf": "pdf", "application/epub+zip": "epub", "application/xml": "xml", "text/xml": "xml", "application/x-latex": "latex",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp",
}
