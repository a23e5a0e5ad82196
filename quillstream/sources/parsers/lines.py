"""Formats read line by line: CSV, AsciiDoc, WebVTT, LaTeX."""

from __future__ import annotations

import csv
import io
import re

from quillstream.sources.parsers.nodes import decode, escape, flat, heading, item, node, paragraph, picture, table

DELIMITERS = (",", ";", "\t", "|", ":")


def sniff(text: str) -> str:
    """The most frequent candidate in the first line, the earlier of equals."""
    line = text.split("\n", 1)[0]
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def parse_csv(content: bytes | str, name: str = "") -> list[dict]:
    text = decode(content)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=sniff(text)) if r]
    return [table(rows)] if rows else []


def parse_webvtt(content: bytes | str, name: str = "") -> list[dict]:
    """A paragraph for each payload line; only bold and italic cues leave marks."""
    out: list[dict] = []
    for k, part in enumerate(re.split(r"\n{2,}", decode(content).replace("\r\n", "\n").replace("\r", "\n").strip())):
        lines = part.split("\n")
        if k == 0 and lines[0].startswith("WEBVTT"):
            if title := lines[0][6:].strip():
                out.append(heading(1, escape(title)))
            continue
        if re.match(r"(NOTE|STYLE|REGION)\b", lines[0]):
            continue
        at = next((i for i, x in enumerate(lines) if "-->" in x), None)
        if at is None:
            continue
        for x in lines[at + 1 :]:
            x = re.sub(r"<(/?)(b|i)(?:\.[^>]*)?>", lambda m: "**" if m[2] == "b" else "*", x)
            x = re.sub(r"<[^>]*>", "", x)
            if x.strip():
                out.append(paragraph(flat(x)))
    return out


def parse_asciidoc(content: bytes | str, name: str = "") -> list[dict]:
    """A line machine; images, and sections whose parent level is absent, go to the end."""
    out: list[dict] = []
    late: list[dict] = []
    text: list[str] = []
    rows: list[list[str]] | None = None
    caption: str | None = None
    levels: set[int] = set()
    listing = False

    def flush() -> None:
        if text:
            out.append(paragraph(escape(flat(" ".join(text)))))
            text.clear()

    for line in decode(content).split("\n"):
        line = line.rstrip()
        if rows is not None:
            if line.startswith("|==="):
                if rows:
                    out.append(table(rows, caption=caption))
                caption, rows = None, None
            elif line.startswith("|"):
                rows.append([c.strip() for c in line[1:].split("|")])
            continue
        if m := re.match(r"= (.+)", line):
            flush()
            out.append(heading(1, escape(m[1])))
            levels.add(1)
        elif m := re.match(r"(={2,6}) (.+)", line):
            flush()
            level = len(m[1])
            (out if level == 2 or level - 1 in levels else late).append(heading(level, escape(m[2])))
            levels.add(level)
        elif m := re.match(r"\s*(\*+|-|\d+\.|\.+) (.+)", line):
            flush()
            depth = len(m[1]) - 1 if m[1][0] in "*." else (len(line) - len(line.lstrip())) // 2
            out.append(item(escape(m[2]), depth, first=not listing))
            listing = True
            continue
        elif listing and line:
            pass  # the line that ends a list is swallowed
        elif line.startswith("|==="):
            flush()
            rows = []
        elif m := re.match(r"image::?([^\[]+)\[([^\]]*)\]", line):
            flush()
            late.append(picture(caption or m[2].split(",")[0].strip('" ') or None))
            caption = None
        elif m := re.match(r"\.([^\s.].*)", line):
            flush()
            caption = m[1]
        elif line.strip():
            text.append(line.strip())
        else:
            flush()
        listing = listing and not line
    flush()
    return [*out, *late]


SECTIONS = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
BODIES = re.compile(r"\\begin\{(?P<env>[a-zA-Z]+\*?)\}|\\(?P<section>chapter|section|subsection|subsubsection|paragraph)\*?\s*(?=\{)|\\\[(?P<display>.+?)\\\]|\$\$(?P<dollars>.+?)\$\$|(?<!\\)\$(?P<inline>[^$]+?)(?<!\\)\$|(?P<gap>\n\s*\n)", re.S)
MATH = frozenset(f"{e}{s}" for e in ("equation", "align", "gather", "multline", "displaymath", "eqnarray") for s in ("", "*"))
INNER = frozenset("document abstract quote quotation center flushleft flushright minipage titlepage".split())


def braced(s: str, at: int) -> tuple[str, int]:
    """What is in the braces from at, and where they end."""
    depth = 0
    for i in range(at, len(s)):
        if s[i] == "{" and s[i - 1 : i] != "\\":
            depth += 1
        elif s[i] == "}" and s[i - 1 : i] != "\\":
            depth -= 1
            if not depth:
                return s[at + 1 : i], i + 1
    return s[at + 1 :], len(s)


def clean_latex(s: str) -> str:
    s = re.sub(r"\\(?:textbf|bfseries)\{([^{}]*)\}", r"**\1**", s)
    s = re.sub(r"\\(?:textit|emph)\{([^{}]*)\}", r"*\1*", s)
    s = re.sub(r"\\(?:cite[tp]?|ref|eqref|autoref)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"[\1]", s)
    s = re.sub(r"\\href\{([^{}]*)\}\{([^{}]*)\}", r"[\2](\1)", s)
    s = re.sub(r"\\(?:label|vspace|hspace|bibliography|bibliographystyle|pagestyle|thispagestyle|usepackage|documentclass|input|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", s)
    for _ in range(4):
        s = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", s)
    s = s.replace("~", " ").replace("``", '"').replace("''", '"').replace("---", "—").replace("--", "–")
    s = re.sub(r"\\([%&$#_{}])", r"\1", s)
    s = re.sub(r"\\[a-zA-Z]+\*?|\\\\", " ", s)
    return flat(s.replace("{", "").replace("}", ""))


def parse_latex(content: bytes | str, name: str = "") -> list[dict]:
    src = re.sub(r"(?<!\\)%[^\n]*", "", decode(content))
    out: list[dict] = []
    for macro, make in (("title", lambda t: heading(1, t)), ("author", paragraph)):
        if m := re.search(rf"\\{macro}\s*(?=\{{)", src):
            if t := clean_latex(braced(src, m.end())[0]):
                out.append(make(t))
    if m := re.search(r"\\begin\{document\}(.*?)(\\end\{document\}|$)", src, re.S):
        src = m[1]
    src = re.sub(r"\\(?:title|author|date)\s*\{[^{}]*\}|\\maketitle", "", src)
    return [*out, *_latex_body(src)]


def _latex_body(src: str) -> list[dict]:
    out: list[dict] = []
    text: list[str] = []

    def flush() -> None:
        if t := clean_latex("".join(text)):
            out.append(paragraph(t))
        text.clear()

    at = 0
    while m := BODIES.search(src, at):
        text.append(src[at : m.start()])
        at = m.end()
        if m["gap"] is not None:
            flush()
        elif m["section"]:
            flush()
            title, at = braced(src, at)
            out.append(heading(SECTIONS[m["section"]], clean_latex(title)))
        elif (tex := m["display"] or m["dollars"] or m["inline"]) is not None:
            flush()
            out.append(node("formula", tex.strip()))
        else:
            flush()
            env = m["env"]
            end = re.compile(rf"\\(begin|end)\{{{re.escape(env)}\}}")
            depth, stop, close = 1, len(src), len(src)
            for e in end.finditer(src, at):
                depth += 1 if e[1] == "begin" else -1
                if not depth:
                    stop, close = e.start(), e.end()
                    break
            body, at = src[at:stop], close
            if env in MATH:
                out.append(node("formula", re.sub(r"\\label\{[^}]*\}", "", body).strip()))
            elif env in ("itemize", "enumerate", "description"):
                out += [item(clean_latex(x), 0, first=k == 0) for k, x in enumerate(re.split(r"\\item(?:\s*\[[^\]]*\])?", body)[1:])]
            elif env in ("verbatim", "lstlisting", "minted"):
                out.append(node("code", body.strip("\n")))
            elif env in ("tabular", "tabular*", "array", "longtable"):
                body = re.sub(r"^\s*(\{[^{}]*\}|\[[^\]]*\])+", "", re.sub(r"\\(hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", body))
                rows = [[clean_latex(c) for c in re.split(r"(?<!\\)&", r)] for r in body.split("\\\\") if r.strip()]
                if rows:
                    out.append(table(rows))
            elif env in ("figure", "figure*", "table", "table*"):
                cap = re.search(r"\\caption\s*(?=\{)", body)
                said = clean_latex(braced(body, cap.end())[0]) if cap else None
                inner = [n for n in _latex_body(re.sub(r"\\caption\s*\{[^{}]*\}", "", body)) if n["kind"] == "table"]
                out += [n | {"caption": said} for n in inner] if inner else [picture(said)] if env.startswith("figure") else []
            elif env in INNER:
                if env == "abstract":
                    out.append(heading(2, "Abstract"))
                out += _latex_body(body)
    text.append(src[at:])
    flush()
    return out
