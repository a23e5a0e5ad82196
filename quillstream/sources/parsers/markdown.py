"""Markdown: blocks by line, then inline markup."""

from __future__ import annotations

import html as entities
import re

from quillstream.sources.parsers import html
from quillstream.sources.parsers.nodes import Style, decode, escape, heading, item, mark, node, paragraph, picture, table

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`\s]*)[^`]*$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
BULLET = re.compile(r"^( *)([-*+])(?:[ \t]+(.*))?$")
NUMBER = re.compile(r"^( *)(\d{1,9})([.)])(?:[ \t]+(.*))?$")
RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
MARKUP = re.compile(r"^ {0,3}</?(?:address|article|aside|blockquote|body|center|details|div|dl|dt|dd|fieldset|figure|footer|form|h[1-6]|header|hr|html|iframe|li|main|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|tr|ul)\b|^ {0,3}<!--", re.I)
INLINE = re.compile(r"""\\(?P<escaped>[!-/:-@\[-`{-~])|(?P<ticks>`+)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]*)[^)]*\)|\[(?P<label>(?:[^\[\]]|\[[^\]]*\])*)\]\((?P<href>[^)\s]*)[^)]*\)|<(?P<auto>https?://[^>\s]+)>|(?P<strong>\*\*|__)(?=\S)(?P<s>.+?)(?<=\S)(?P=strong)|~~(?=\S)(?P<d>.+?)(?<=\S)~~|(?P<em>\*|(?<!\w)_)(?=\S)(?P<e>.+?)(?<=\S)(?P=em)(?!\w)|(?P<tag></?[A-Za-z][^<>]*>)""", re.S | re.X)


def inline(s: str, style: Style = Style()) -> str:
    """Markup read and written again in one form; inline tags go."""
    out, at = [], 0
    words = lambda t: escape(entities.unescape(re.sub(r"[ \t]*\n[ \t]*", " ", t)))
    for m in INLINE.finditer(s):
        out.append(words(s[at : m.start()]))
        at = m.end()
        g = m.groupdict()
        if g["escaped"] is not None:
            out.append(escape(g["escaped"]))
        elif g["code"] is not None:
            out.append(mark(re.sub(r"\s+", " ", g["code"]).strip(), Style(code=True)))
        elif g["alt"] is not None:
            out.append(f"![{g['alt']}]({g['src']})")
        elif g["label"] is not None:
            out.append(f"[{inline(g['label'])}]({g['href']})")
        elif g["auto"]:
            out.append(f"[{g['auto']}]({g['auto']})")
        elif g["s"] is not None:
            out.append(f"**{inline(g['s'])}**")
        elif g["d"] is not None:
            out.append(f"~~{inline(g['d'])}~~")
        elif g["e"] is not None:
            out.append(f"*{inline(g['e'])}*")
    out.append(words(s[at:]))
    return "".join(out).strip()


def strip_markup(s: str) -> str:
    s = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)
    return re.sub(r"(\*\*|__|~~|`|(?<!\w)[*_]|[*_](?!\w))", "", s).strip()


def cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [strip_markup(inline(c.replace("\\|", "|"))) for c in re.split(r"(?<!\\)\|", line)]


def block_start(line: str) -> bool:
    return bool(not line.strip() or ATX.match(line) or FENCE.match(line) or RULE.match(line) or BULLET.match(line) or re.match(r"^ {0,3}1[.)]\s", line) or line.lstrip().startswith(">") or MARKUP.match(line))


def blocks(lines: list[str], level: int = 0) -> list[dict]:
    out: list[dict] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := FENCE.match(line):
            j = i + 1
            close = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$")
            while j < len(lines) and not close.match(lines[j]):
                j += 1
            out.append(node("code", "\n".join(lines[i + 1 : j]), language=m[2] or None))
            i = j + 1
        elif m := ATX.match(line):
            if text := inline(m[2] or ""):
                out.append(heading(len(m[1]), text))
            i += 1
        elif RULE.match(line):
            i += 1
        elif MARKUP.match(line):
            j = i
            while j < len(lines) and lines[j].strip():
                j += 1
            out += html.parse("\n".join(lines[i:j]), furniture=False)
            i = j
        elif line.lstrip().startswith(">"):
            j, inner = i, []
            while j < len(lines) and lines[j].strip() and (lines[j].lstrip().startswith(">") or not block_start(lines[j])):
                inner.append(re.sub(r"^ {0,3}> ?", "", lines[j]))
                j += 1
            out += blocks(inner, level)
            i = j
        elif BULLET.match(line) or NUMBER.match(line):
            i, found = items(lines, i, level)
            out += found
        elif i + 1 < len(lines) and "|" in line and DELIMITER.match(lines[i + 1]) and len(cells(line)) == len(cells(lines[i + 1])):
            j, rows = i + 2, [cells(line)]
            while j < len(lines) and lines[j].strip() and "|" in lines[j]:
                rows.append((cells(lines[j]) + [""] * len(rows[0]))[: len(rows[0])])
                j += 1
            out.append(table(rows))
            i = j
        else:
            j = i + 1
            under = None
            while j < len(lines) and not (under := re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[j])) and not block_start(lines[j]):
                j += 1
            text = "\n".join(x.strip() for x in lines[i:j])
            if under and j < len(lines):
                out.append(heading(1 if under[1][0] == "=" else 2, inline(text)))
                j += 1
            elif m := re.fullmatch(r"`([^`]+)`", text.strip()):
                out.append(node("code", m[1]))
            elif m := re.fullmatch(r"!\[([^\]]*)\]\([^)]*\)", text.strip()):
                out.append(picture(m[1]))
            elif m := re.fullmatch(r"\$\$(.+)\$\$", text.strip(), re.S):
                out.append(node("formula", m[1].strip()))
            elif t := inline(text):
                out.append(paragraph(t))
            i = j
    return out


def items(lines: list[str], i: int, level: int) -> tuple[int, list[dict]]:
    """One list from line i: where it ends, and its items with what is nested in them."""
    out: list[dict] = []
    kind = BULLET if BULLET.match(lines[i]) else NUMBER
    first, number, sign = True, None, None
    base = len(kind.match(lines[i])[1])
    while i < len(lines):
        m = kind.match(lines[i])
        if not m or len(m[1]) < base or len(m[1]) > base + 3 or RULE.match(lines[i]):
            break
        s = m[2] if kind is BULLET else m[3]
        if sign not in (None, s):
            break
        sign = s
        number = (int(m[2]) if number is None else number + 1) if kind is NUMBER else 1
        body = m[3] if kind is BULLET else m[4]
        width = len(m[1]) + len(m[2]) + (1 if kind is BULLET else 2)
        j, inner = i + 1, [body or ""]
        while j < len(lines):
            x = lines[j]
            if not x.strip():
                if j + 1 < len(lines) and (len(lines[j + 1]) - len(lines[j + 1].lstrip()) >= width and lines[j + 1].strip()):
                    inner.append("")
                    j += 1
                    continue
                break
            pad = len(x) - len(x.lstrip())
            if pad >= min(width, base + 2):
                inner.append(x[min(pad, width) :])
            elif block_start(x) or NUMBER.match(x):
                break
            else:
                inner.append(x.strip())
            j += 1
        parts = blocks(inner, level + 1)
        lead = parts.pop(0)["text"] if parts and parts[0]["kind"] == "paragraph" else ""
        if box := re.match(r"\[([ xX])\]\s+(.*)", lead, re.S):
            out.append(node("checkbox", box[2], checked=box[1] != " "))
        else:
            out.append(item(lead, level, kind is NUMBER, number, first, marker=None if kind is BULLET else f"{number}{sign}"))
        first = False
        out += parts
        while j < len(lines) and not lines[j].strip():
            j += 1
        i = j
    return i, out


def parse(content: bytes | str, name: str = "") -> list[dict]:
    return blocks(decode(content).replace("\r\n", "\n").replace("\t", "    ").split("\n"))


ANNOTATED = re.compile(r"<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>", re.S)


def parse_annotated(content: bytes | str, name: str = "") -> list[dict]:
    """Markdown whose blocks are announced by ref and det marks: a label and boxes, then the content."""
    text = decode(content)
    found = list(ANNOTATED.finditer(text))
    out: list[dict] = []
    for m, after in zip(found, [*[f.start() for f in found[1:]], len(text)]):
        label, body = m[1].strip(), text[m.end() : after].strip()
        place = [int(x) for x in re.findall(r"\d+", m[2])[:4]] or None
        more = {"location": place}
        if label in ("image", "figure"):
            out.append(picture(None, **more))
        elif label in ("image_caption", "figure_caption") and out and out[-1]["kind"] == "picture":
            out[-1]["caption"] = inline(body)
        elif label == "title":
            out.append(heading(1, inline(body.lstrip("# ")), **more))
        elif label == "sub_title":
            marks = len(body) - len(body.lstrip("#"))
            out.append(heading(marks if marks > 1 else 2, inline(body.lstrip("# ")), **more))
        elif label == "table":
            out += [n | more for n in html.parse(body, furniture=False)] if "<table" in body else [n | more for n in parse(body)]
        elif label == "equation":
            out.append(node("formula", re.sub(r"^\\\[|\\\]$|^\$\$|\$\$$", "", body).strip(), **more))
        elif body:
            out += [n | more for n in parse(body)]
    return out


def parse_file(content: bytes | str, name: str = "") -> list[dict]:
    """Text files: a patent record dump, annotated Markdown, or Markdown."""
    text = decode(content)
    if text.startswith("PATN"):
        return [node("text_dump", text)]
    return parse_annotated(text) if ANNOTATED.search(text) else parse(text)
