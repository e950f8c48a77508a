"""Equations, tables, notes, charts and formulas of office files, by plain examples."""

import io
import zipfile
from xml.etree import ElementTree

import pytest

from lectern.sources.equations import bracketed, equation_text
from lectern.sources.office import office_text

M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def run(text):
    return f"<m:r><m:t>{text}</m:t></m:r>"


def part(name, inner):
    return f"<m:{name}>{inner}</m:{name}>"


@pytest.mark.parametrize(
    ("inner", "said"),
    [
        (part("f", part("num", run("a+b")) + part("den", run("2"))), "(a+b)/2"),
        (part("f", part("den", run("2"))), "/2"),
        (part("sSup", part("e", run("x")) + part("sup", run("n-1"))), "x^(n-1)"),
        (part("sSubSup", part("e", run("x")) + part("sub", run("i")) + part("sup", run("2"))), "x_i^2"),
        (part("sPre", part("sub", run("1")) + part("sup", run("2")) + part("e", run("H"))), "_1^2H"),
        (part("nary", '<m:naryPr><m:chr m:val="∑"/></m:naryPr>' + part("sub", run("t=1")) + part("sup", run("T")) + part("e", run("y"))), "∑_(t=1)^T y"),
        (part("nary", part("sub", "") + part("e", run("f(x)dx"))), "∫ f(x)dx"),
        (part("rad", part("deg", "") + part("e", run("x+1"))), "√(x+1)"),
        (part("rad", part("deg", run("3")) + part("e", run("8"))), "root3(8)"),
        (part("d", '<m:dPr><m:begChr m:val="["/><m:endChr m:val="]"/></m:dPr>' + part("e", run("a")) + part("e", run("b"))), "[a|b]"),
        (part("func", part("fName", run("log")) + part("e", run("x+1"))), "log(x+1)"),
        (part("limLow", part("e", run("lim")) + part("lim", run("n→∞"))), "lim_(n→∞)"),
        (part("acc", part("e", run("x"))), "x̂"),
        (part("bar", part("e", run("xy z"))), "bar(xy z)"),
        (part("m", part("mr", part("e", run("1")) + part("e", run("0"))) + part("mr", part("e", run("0")) + part("e", run("1")))), "[1, 0; 0, 1]"),
        (part("eqArr", part("e", run("a=1")) + part("e", run("b=2"))), "a=1; b=2"),
    ],
)
def test_equations(inner, said):
    assert equation_text(ElementTree.fromstring(f"<m:oMath {M}>{inner}</m:oMath>")) == said


def test_brackets_and_depth():
    assert [bracketed(t) for t in ("(a)(b)", "(a+b)", " x2 ", "a b", "", "[a)", "(")] == ["((a)(b))", "(a+b)", "x2", "(a b)", "()", "([a))", "("]
    deep = "<m:e>" * 3000 + run("x") + "</m:e>" * 3000
    assert equation_text(ElementTree.fromstring(f"<m:oMath {M}>{deep}</m:oMath>")) == "x"


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*kinds):
    base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return "<Relationships>" + "".join(f'<Relationship Id="r{n}" Type="{base}/{k}" Target="{t}"/>' for n, (k, t) in enumerate(kinds, 1)) + "</Relationships>"


def spaces(**names):
    return " ".join(f'xmlns:{k}="http://schemas.openxmlformats.org/{v}"' for k, v in names.items())


def read(spark, kind, data):
    rows = spark.createDataFrame([("f", kind, data)], "id string, kind string, content binary")
    return office_text(rows, "id", "kind", "content").first()


def test_document_with_table_and_equation(spark):
    own = spaces(w="wordprocessingml/2006/main", m="officeDocument/2006/math")
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = (
        f'<w:p><w:r><w:t>so</w:t></w:r><m:oMath>{run("x=1")}</m:oMath><w:r><w:t>holds</w:t></w:r></w:p>'
        f"<w:tbl><w:tr>{cell('a|b')}{cell('c')}</w:tr><w:tr>{cell('d')}</w:tr></w:tbl>{p('end')}"
    )
    got = read(spark, "document", packed({"word/document.xml": f"<w:document {own}><w:body>{body}</w:body></w:document>"}))
    assert got.text == "so [equation: x=1] holds\n\n| a\\|b | c |\n| --- | --- |\n| d |  |\n\nend"


def test_slide_with_notes_table_and_chart(spark):
    own = spaces(p="presentationml/2006/main", a="drawingml/2006/main", c="drawingml/2006/chart", r="officeDocument/2006/relationships")
    p = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    pts = lambda role, *v: f"<c:{role}>" + "".join(f'<c:pt idx="{i}"><c:v>{x}</c:v></c:pt>' for i, x in enumerate(v)) + f"</c:{role}>"
    chart = f"<c:chartSpace {own}><c:chart><c:title>{p('Growth')}</c:title><c:plotArea><c:barChart><c:ser>{pts('tx', 'Sales')}{pts('cat', 'Q1', 'Q2')}{pts('val', '1.50', '2')}</c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>"
    notes = f'<p:notes {own}><p:sp><p:nvPr><p:ph type="sldNum"/></p:nvPr>{p("7")}</p:sp><p:sp><p:nvPr><p:ph type="body"/></p:nvPr>{p("say it")}</p:sp></p:notes>'
    slide = f'<p:sld {own} show="0">{p("Title")}{p("line")}<a:tbl><a:tr><a:tc>{p("h")}</a:tc></a:tr><a:tr><a:tc>{p("v")}</a:tc></a:tr></a:tbl></p:sld>'
    deck = packed({
        "ppt/presentation.xml": f'<p:presentation {own}><p:sldId r:id="r1"/></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(("slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": rels(("chart", "../charts/chart1.xml"), ("notesSlide", "/ppt/notesSlides/n1.xml")),
        "ppt/charts/chart1.xml": chart, "ppt/notesSlides/n1.xml": notes,
    })
    assert read(spark, "slides", deck).text == (
        "## [Slide 1] Title (hidden slide)\nline\n\n| h |\n| --- |\n| v |\n\nChart (bar): Growth\n\n"
        "| Category | Sales |\n| --- | --- |\n| Q1 | 1.5 |\n| Q2 | 2 |\n\nSpeaker notes:\n\nsay it"
    )


def test_sheet_with_formulas_and_stated_cut(spark):
    own = spaces(s="spreadsheetml/2006/main", r="officeDocument/2006/relationships")
    rows = "".join(f'<s:row><s:c r="A{n}"><s:f>B{n}*2</s:f><s:v>{n}</s:v></s:c></s:row>' for n in range(1, 303))
    book = packed({"xl/workbook.xml": f'<s:workbook {own}><s:sheet name="S" r:id="r1"/></s:workbook>', "xl/_rels/workbook.xml.rels": rels(("worksheet", "worksheets/s.xml")), "xl/worksheets/s.xml": f"<s:worksheet {own}>{rows}</s:worksheet>"})
    text = read(spark, "spreadsheet", book).text
    assert text.startswith("## [Sheet: S]\n1\n2\n") and "(Showing the first 300 of 302 rows.)" in text
    assert "- A1: `=B1*2`" in text and "- A300: `=B300*2`" in text and "A301" not in text
    assert read(spark, "unknown", book).error == "KeyError"
