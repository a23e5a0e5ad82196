"""Text expressions: everything here is a Column made of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters and numbers; combining marks that count as alphabetic are the difference to [\p{L}\p{N}].
TERM_BREAK = r"[^\p{L}\p{N}]+"
SPACE = r"(?U)\s+"


def fold(c: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(c, UPPER, LOWER)


def terms(c: Column) -> Column:
    """Search terms: runs of letters and digits, ASCII-folded."""
    return F.array_remove(F.split(fold(F.coalesce(c, F.lit(""))), TERM_BREAK), "")


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def is_heading_line(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^ {0,3}#{1,6}(\s|$)"))


def is_fence_line(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^ {0,3}(`{3}|~{3})"))


def heading_line(path: Column) -> Column:
    """# A > B, or nothing without headings."""
    return F.when(F.size(path) > 0, F.concat(F.lit("# "), F.array_join(path, " > "))).otherwise("")


def contextualize(path: Column, text: Column) -> Column:
    """Headings and text, a line each."""
    return F.concat_ws("\n", path, text)


def contextualize_window(path: Column, text: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(heading_line(path), F.lit("\n\n"), text)).otherwise(text)


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape_html(c: Column) -> Column:
    """The reverse, and of escaped underscores; ampersands after angle brackets."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("\\_", "_")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_underscores(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!\\)_", r"\\_")


#: Typographic characters and their ASCII forms.
TYPOGRAPHIC = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " ", "…": "..."}


def normalize_space(c: Column) -> Column:
    """Typographic characters to ASCII, white space to single spaces, trimmed."""
    one = {a: b for a, b in TYPOGRAPHIC.items() if len(b) == 1}
    c = F.translate(c, "".join(one), "".join(one.values()))
    for a, b in TYPOGRAPHIC.items():
        if len(b) > 1:
            c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, SPACE, " "))


def dehyphenate(c: Column) -> Column:
    """Joins words broken at line ends, then lines."""
    return normalize_space(F.regexp_replace(c, r"(\p{L})[-­]\n(\p{Ll})", "$1$2"))


def tighten(c: Column) -> Column:
    """Spaces before closing and after opening punctuation go, in a fixed order."""
    for a, b in ((" .", "."), (" ,", ","), (" ;", ";"), (" :", ":"), (" )", ")"), ("( ", "("), (" ]", "]"), ("[ ", "[")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def humanize(label: Column) -> Column:
    s = F.replace(label, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 20))


def table_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("&#124;"))


def is_number(c: Column) -> Column:
    """Numbers with or without thousands separators."""
    plain = F.trim(c)
    grouped = F.regexp_like(plain, F.lit(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"))
    return F.coalesce(grouped | plain.try_cast("double").isNotNull() & ~F.regexp_like(plain, F.lit(r"(?i)[df]$")), F.lit(False))


def strip_image_markers(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: F.trim(line) != "<!-- image -->"), "\n")


def data_uri(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\s", ""))


def data_uri_bytes(uri: Column) -> Column:
    return F.unbase64(F.regexp_extract(uri, r"^data:[^,]*;base64,(.*)$", 1))


def normalize_url(c: Column) -> Column:
    """A bare host gets its slash."""
    return F.regexp_replace(c, r"^(https?://[^/?#]+)$", "$1/")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def safe_relative(path: Column) -> Column:
    """Without empty parts, dots and parents."""
    return F.array_join(F.filter(F.split(path, r"[/\\]"), lambda p: ~p.isin("", ".", "..")), "/")


DELIMITERS = (",", ";", "\t", "|", ":")


def sniff_delimiter(content: Column) -> Column:
    """The most frequent candidate in the first line; of equals the earlier one; a comma without any."""
    line = F.element_at(F.split(content, "\n", 2), 1)
    counts = [F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS]
    best, found = F.lit(DELIMITERS[0]), counts[0]
    for d, n in zip(DELIMITERS[1:], counts[1:]):
        best, found = F.when(n > found, F.lit(d)).otherwise(best), F.greatest(found, n)
    return best


def media_seconds(seconds: Column) -> Column:
    """At most two decimals, trailing zeros gone."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", seconds), "0+$", ""), r"\.$", "")


def ellipsize(c: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(c, SPACE, " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def clean_rewrite(line: Column) -> Column:
    """A line of a numbered or bulleted list of queries, without its marker."""
    return F.trim(F.regexp_replace(F.trim(line), r"^[0-9.\-)\s]+", ""))


def is_relevant(text: Column, expected: Column) -> Column:
    """Whether the text contains any expected substring, ASCII case aside."""
    return F.exists(expected, lambda e: F.contains(fold(text), fold(e)))


def rate(amount: Column, seconds: Column) -> Column:
    return F.when(seconds > 1e-9, amount / seconds)


def first_heading(markdown: Column) -> Column:
    """The first line that starts with #, without its marks; null without one."""
    found = F.regexp_extract(markdown, r"(?m)^\s*#+\s*(\S.*?)\s*$", 1)
    return F.when(found != "", found)


def title_of(markdown: Column, path: Column) -> Column:
    return F.coalesce(first_heading(markdown), file_stem(path))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def looks_like_xml(text: Column) -> Column:
    return F.regexp_like(F.ltrim(text), F.lit(r"(?i)^(<\?xml|<!doctype(?!\s*html))"))


def xml_dialect(text: Column) -> Column:
    """uspto, jats, xbrl or xml, from the first 4000 characters."""
    head = F.lower(F.left(text, F.lit(4000)))
    return F.when(F.contains(head, F.lit("us-patent")) | F.contains(head, F.lit("patdoc")) | F.contains(head, F.lit("pap-v1")), "uspto").when(F.contains(head, F.lit("<xbrl")) | F.contains(head, F.lit(":xbrl")), "xbrl").when(F.contains(head, F.lit("jats")) | F.regexp_like(head, F.lit(r"<article[\s>]")), "jats").otherwise("xml")


def percent_decode(c: Column) -> Column:
    """%XX only; a plus sign stays."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def split_sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")
