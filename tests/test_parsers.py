from __future__ import annotations

import io
import json
import zipfile

import pytest

from quillstream.operators import serialize as S
from quillstream.sources.parsers import html, markdown, parse
from quillstream.sources.parsers.office import cell_range, latex, parse_docx, parse_pptx, parse_xlsx, regions, show_number
from quillstream.sources.parsers.tags import grid, spans


def brief(nodes):
    return [(n["kind"], n.get("level"), n.get("text"), n.get("layer")) for n in nodes]


def texts(nodes, kind=None):
    return [n.get("text") for n in nodes if not n.get("layer") and (kind is None or n["kind"] == kind)]


# HTML


def test_title_and_what_precedes_the_heading_are_furniture():
    n = html.parse("<title>T</title><nav>n</nav><h1>H</h1><p>x</p><footer><p>f</p></footer>")
    assert brief(n) == [("heading", 1, "T", "furniture"), ("paragraph", None, "n", "furniture"), ("heading", 1, "H", None), ("paragraph", None, "x", None), ("paragraph", None, "f", "furniture")]


def test_without_a_heading_nothing_is_furniture():
    assert brief(html.parse("<p>a</p><p>b</p>")) == [("paragraph", None, "a", None), ("paragraph", None, "b", None)]


def test_formatting_left_open_goes_on():
    assert texts(html.parse("<p><b>a<p>b")) == ["**a**", "**b**"]


def test_marker_order_and_links():
    assert texts(html.parse('<p><a href="https://x.org"><b><i>z</i></b></a>.')) == ["[***z***](https://x.org/) ."]
    assert texts(html.parse("<p><code>a_b</code> c_d &lt;")) == ["`a_b` c\\_d &lt;"]


def test_lists_nest_and_count():
    n = html.parse('<ol start="3"><li>a<ul><li>b</ul><li>c</ol><dl><dt>t<dd>d</dl>')
    assert [(x["text"], x["level"], x["ordered"], x["number"]) for x in n] == [("a", 0, True, 3), ("b", 1, False, 1), ("c", 0, True, 4), ("**t**", 0, False, 1), ("d", 1, False, 1)]


def test_table_spans_repeat_text():
    (t,) = html.parse("<table><tr><th colspan=2>h<tr><td rowspan=2>a<td>b<tr><td>c</table>")
    assert t["table"]["rows"] == [["h", "h"], ["a", "b"], ["a", "c"]] and t["table"]["header_rows"] == [True, False, False]


@pytest.mark.parametrize("markup, want", [("<figure>x</figure>", []), ('<figure><img alt="q"><figcaption>c</figcaption></figure>', ["picture"]), ("<p><code>x</code></p>", ["code"]), ('<label><input type="checkbox" checked>ok</label>', ["checkbox"]), ('<input type="hidden" value="v">', []), ('<div style="display: none">x</div>', []), ('<div aria-hidden="true">x</div>', ["paragraph"]), ("<hr>", [])])
def test_blocks(markup, want):
    assert [n["kind"] for n in html.parse(markup)] == want


def test_deep_trees_are_flattened():
    assert brief(html.parse("<div>" * 3000 + "x")) == [("paragraph", None, "x", None)]


# Markdown


def test_markdown_blocks():
    n = markdown.parse("# A #\n\ntext\nmore\n\n```py\n# no\n```\n\n- a\n  - b\n\n1. c\n2. d\n\n|x|y|\n|-|-|\n|1|2|\n\n> q\n\n`solo`\n\nS\n---\n")
    assert [x["kind"] for x in n] == ["heading", "paragraph", "code", "list_item", "list_item", "list_item", "list_item", "table", "paragraph", "code", "heading"]
    assert n[1]["text"] == "text more" and n[2]["text"] == "# no" and n[4]["level"] == 1 and n[6]["number"] == 2 and n[-1]["level"] == 2


def test_markdown_inline():
    assert markdown.inline("a *b* __c__ ~~d~~ `e_f` [g](h) <i>x</i> \\*k\\* snake_case") == "a *b* **c** ~~d~~ `e_f` [g](h) x *k* snake\\_case"


def test_hash_without_space_is_text():
    assert brief(markdown.parse("#tag"))[0][0] == "paragraph"


def test_patent_dump_and_annotated_text():
    assert parse("markdown", b"PATN\nx")[0]["kind"] == "text_dump"
    n = parse("markdown", "<|ref|>title<|/ref|><|det|>[[1,2,3,4]]<|/det|>\n# T\n<|ref|>text<|/ref|><|det|>[[1,2,3,4]]<|/det|>\nbody\n<|ref|>image<|/ref|><|det|>[[5,6,7,8]]<|/det|>\n<|ref|>image_caption<|/ref|><|det|>[[5,6,7,8]]<|/det|>\ncap")
    assert [x["kind"] for x in n] == ["heading", "paragraph", "picture"] and n[2]["caption"] == "cap" and n[0]["location"] == [1, 2, 3, 4]


# Lines


@pytest.mark.parametrize("text, width", [("a,b\n1,2\n", 2), ("a;b;c\n1,2;3;4\n", 3), ("a\tb\n1\t2", 2), ("a|b\n", 2), ("a:b\n", 2), ("a\nb,c\n", 2), ('a,b\n"x,y",2\n', 2), ("a,b\n1\n", 2), ("a\n1,2,3\n", 3)])
def test_csv(text, width):
    (t,) = parse("csv", text)
    assert all(len(r) == width for r in t["table"]["rows"])


def test_csv_empty():
    assert parse("csv", b"") == []


def test_webvtt():
    n = parse("webvtt", "WEBVTT Talk\n\nNOTE no\n\n1\n00:00.000 --> 00:01.000\n<b>hi</b>\n<v Ann>there\n")
    assert texts(n) == ["Talk", "**hi**", "there"]


def test_asciidoc_order():
    n = parse("asciidoc", "= T\n\n==== deep\n\nimage::x.png[alt]\n\n.cap\n|===\n|a|b\n|===\n\n== S\nlast\n")
    assert [x["kind"] for x in n] == ["heading", "table", "heading", "paragraph", "heading", "picture"] and n[1]["caption"] == "cap"


def test_latex():
    n = parse("latex", r"\title{T} % no" + "\n" + r"\begin{document}\section{A}x $y$ z\[ w \]\begin{enumerate}\item i\end{enumerate}\begin{foo}gone\end{foo}\end{document}")
    assert [(x["kind"], x["text"]) for x in n] == [("heading", "T"), ("heading", "A"), ("paragraph", "x"), ("formula", "y"), ("paragraph", "z"), ("formula", "w"), ("list_item", "i")]


# Containers


def test_email():
    n = parse("email", b"Subject: Hi\nFrom: A <a@x.org>\nTo: b@x.org\nDate: Mon, 1 Jan 2024 10:00:00 +0100\n\none\n\ntwo\n")
    assert texts(n) == ["Hi", "From: A &lt;a@x.org&gt;", "To: b@x.org", "Date: 2024-01-01T10:00:00+01:00", "one", "two"]


def test_epub_follows_the_spine():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package><manifest><item id="a" href="a.html" media-type="application/xhtml+xml"/><item id="b" href="b.html" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.html", "<h1>A</h1>")
        z.writestr("o/b.html", "<h1>B</h1>")
    assert texts(parse("epub", out.getvalue())) == ["B", "A"]


def test_mhtml():
    m = b'MIME-Version: 1.0\nContent-Type: multipart/related; boundary="b"\n\n--b\nContent-Type: text/html\n\n<h1>x</h1><p>y</p>\n--b--\n'
    assert texts(parse("mhtml", m)) == ["x", "y"]


# XML


def test_jats():
    n = parse("xml", '<article><front><article-meta><article-title>T</article-title><contrib contrib-type="author"><name><surname>S</surname><given-names>G</given-names></name></contrib><aff>P</aff><abstract><p>a</p></abstract></article-meta></front><body><sec><title>I</title><p>x<list list-type="order"><list-item><p>l</p></list-item></list>y</p></sec></body><back><ref-list><ref>r</ref></ref-list></back></article>')
    assert texts(n) == ["T", "G S", "P", "Abstract", "a", "I", "x", "l", "y", "References", "r"]


def test_uspto_and_xbrl_and_plain():
    assert texts(parse("xml", "<us-patent-grant><invention-title>T</invention-title><abstract><p>a</p></abstract><description><heading level='1'>H</heading><p>d</p></description><claims><claim>c</claim></claims></us-patent-grant>")) == ["T", "Abstract", "a", "H", "d", "Claims", "c"]
    assert texts(parse("xbrl", "<xbrl><DocumentType>10-K</DocumentType><EntityRegistrantName>E</EntityRegistrantName><XTextBlock>&lt;p&gt;b&lt;/p&gt;</XTextBlock><YTextBlock>&lt;p&gt;b&lt;/p&gt;</YTextBlock></xbrl>")) == ["10-K E", "b"]
    assert texts(parse("xml", "<a>x<b>y</b>&nbsp;z</a>")) == ["x z", "y"]


# Tags


def test_tags():
    n = parse("tags", "<title>T</title><section_header_level_2>S</section_header_level_2><text><loc_1><loc_2><loc_3><loc_4>p</text><otsl><caption>c</caption><ched>a<ched>b<nl><fcel>1<lcel><nl></otsl><code><_Rust_>fn</code>stray<text>cut<title>U</title></bad>")
    assert [(x["kind"], x.get("level"), x.get("text")) for x in n] == [("heading", 1, "T"), ("heading", 3, "S"), ("paragraph", None, "p"), ("paragraph", None, "c"), ("table", None, None), ("code", None, "fn"), ("paragraph", None, "stray"), ("paragraph", None, "cut"), ("heading", 1, "U")]
    assert n[2]["location"] == [1, 2, 3, 4] and n[4]["table"]["rows"] == [["a", "b"], ["1", "1"]] and n[4]["table"]["header_rows"] == [True, False]


def test_grid_spans():
    t = grid([("open", "ched"), ("text", "h"), ("open", "lcel"), ("open", "nl"), ("open", "fcel"), ("text", "a"), ("open", "fcel"), ("text", "b"), ("open", "nl"), ("open", "ucel"), ("open", "fcel"), ("text", "c")])
    assert spans(t) == [(0, 0, 1, 2, "h"), (1, 0, 2, 1, "a"), (1, 1, 1, 1, "b"), (2, 1, 1, 1, "c")]


# Office

W = 'xmlns:w="w" xmlns:m="m"'


def test_docx():
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> rest</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p><m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/numbering.xml", f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
    n = parse_docx(out.getvalue())
    assert [(x["kind"], x.get("text")) for x in n] == [("heading", "Head"), ("paragraph", "**bold** rest"), ("list_item", "one"), ("table", None), ("formula", r"\frac{a}{b}")]
    assert n[2]["ordered"] and n[3]["table"]["rows"] == [["x", "x"], ["y", ""]]


def test_xlsx_regions():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="s" r:id="i"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="i" Type="x/worksheet" Target="s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>a</t></si></sst>")
        z.writestr("xl/s.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.0</v></c></row><row><c r="A2" t="b"><v>1</v></c></row><row><c r="D9" t="str"><v>far</v></c></row></sheetData></worksheet>')
    n = parse_xlsx(out.getvalue())
    assert n[0]["table"]["rows"] == [["a", "2"], ["True", ""]] and n[1]["text"] == "far"


def test_pptx():
    A = 'xmlns:a="a" xmlns:p="p" xmlns:r="r"'
    sp = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {A}><p:sldIdLst><p:sldId id="1" r:id="a"/><p:sldId id="2" r:id="b"/></p:sldIdLst></p:presentation>'.replace('xmlns:r="r"', 'xmlns:r="http://r"'))
        z.writestr("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="a" Type="x/slide" Target="1.xml"/><Relationship Id="b" Type="x/slide" Target="2.xml"/></Relationships>')
        for k in (1, 2):
            z.writestr(f"ppt/{k}.xml", f"<p:sld {A}><p:cSld><p:spTree>{sp('title', f'T{k}')}{sp('body', 'b')}</p:spTree></p:cSld></p:sld>")
    assert [(x["kind"], x.get("text")) for x in parse_pptx(out.getvalue())] == [("heading", "T1"), ("list_item", "b"), ("page_break", None), ("heading", "T2"), ("list_item", "b")]


def test_sheet_helpers():
    assert cell_range("S!$B$2:C4") == (1, 1, 3, 2) and cell_range("AA1") == (0, 26, 0, 26)
    assert show_number("3.0", False) == "3" and show_number("45292", True) == "2024-01-01" and show_number("0.5", False) == "0.5"
    assert [len(g) for g in regions({(0, 0), (0, 1), (2, 2)})] == [2, 1]
    assert latex(None) == ""


# Sinks


SAMPLE = [{"kind": "heading", "level": 1, "text": "T"}, {"kind": "paragraph", "text": "a &lt; b ."}, {"kind": "list_item", "text": "x", "level": 0, "ordered": True, "number": 1, "first_in_list": True}, {"kind": "list_item", "text": "y", "level": 1, "ordered": False, "number": 1, "first_in_list": True}, {"kind": "checkbox", "text": "c", "checked": True}, {"kind": "code", "text": "z", "language": "py"}, {"kind": "picture", "caption": "p"}, {"kind": "table", "table": {"rows": [["a", "n"], ["q", "10"]], "header_rows": [True, False]}}, {"kind": "paragraph", "text": "gone", "layer": "furniture"}]


def test_markdown_sink():
    assert S.to_markdown(SAMPLE) == "# T\n\na &lt; b .\n\n1. x\n    - y\n- [x] c\n\n```\nz\n```\n\np\n\n<!-- image -->\n\n| a   |   n |\n|-----|-----|\n| q   |  10 |"
    assert "a &lt; b." in S.to_markdown(SAMPLE, strict=True) and "```py" in S.to_markdown(SAMPLE, strict=True)
    assert "| a | n |\n| - | - |" in S.to_markdown(SAMPLE, compact=True)


def test_json_sink_round_trip():
    again = parse("json_document", S.to_json(SAMPLE, "n"))
    assert [(n["kind"], n.get("text")) for n in again] == [("heading", "T"), ("paragraph", "a < b ."), ("list_item", "x"), ("list_item", "y"), ("checkbox", "c"), ("code", "z"), ("picture", None), ("table", None)]
    assert json.loads(S.to_json([], "a"))["origin"]["binary_hash"] == 0xAF63DC4C8601EC8C


def test_xml_sink_round_trip():
    again = parse("xml_document", S.to_xml(SAMPLE))
    assert [(n["kind"], n.get("text"), n.get("layer")) for n in again][:4] == [("heading", "T", None), ("paragraph", "a < b .", None), ("list_item", "x", None), ("list_item", "y", None)]
    assert again[-1]["layer"] == "furniture" and again[-2]["table"]["rows"] == [["a", "n"], ["q", "10"]]
    assert S.to_archive(SAMPLE) == S.to_archive(SAMPLE) and parse("xml_document", S.to_archive(SAMPLE)) == again


def test_links_are_recovered_in_order():
    assert S.recover_links("see a and a", [("a", "1"), ("a", "2")]) == "see [a](1) and [a](2)"
