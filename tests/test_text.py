import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import html, stem, text
from lectern.operators import sections


def values(spark, inputs, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("t"))).collect()]


def test_quote_fold(spark):
    got = values(spark, ["“It’s” – **so**…", "see [the page](http://x) now", "a  b\n c", None], text.quote_fold)
    assert got == ['"it\'s" - so...', "see the page now", "a b c", None]


def test_query_terms():
    assert text.query_terms('What is the "Bond Duration" of it?') == ["bond duration"]
    assert text.query_terms("the") == ["the"] and text.query_terms("Duration duration") == ["duration"]


@pytest.mark.parametrize(
    ("words", "numbers"),
    [("Slides 4-6, 9", [4, 5, 6, 9]), ("pp. 3-7", [3, 4, 5, 6, 7]), ("[S12] and page 2", [2, 12]), ("slides 9-4", []), ("none", []), ("page 1-100000", [])],
)
def test_unit_numbers(spark, words, numbers):
    assert values(spark, [words], text.unit_numbers) == [numbers]


def test_times_and_paths(spark):
    assert [str(v) for v in values(spark, ["2024-01-02T03:04:05Z", "2024-01-02 what", "no"], text.iso_time)] == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", "None"]
    assert values(spark, ["a/b/c", "a/b", "../a", "a//b", "a\\b", "/a", None], text.safe_path) == [True, True, False, False, False, False, False]
    assert values(spark, ["a/b/c", "a/b"], text.course_of) == ["a/b", None]
    assert values(spark, ["3661"], lambda c: text.clock(c.cast("double"))) == ["01:01:01"]


def test_sentences(spark):
    assert values(spark, ["One two. Three!  Four?\n- five\n\nsix [seven](u)"], text.sentences) == [["One two.", "Three!", "Four?", "five", "six seven"]]


@pytest.mark.parametrize(
    ("word", "root"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"),
     ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky")],
)
def test_porter(word, root):
    assert stem.porter(word) == root


def test_folds(spark):
    assert stem.folded("réeaù") == "reeau"
    assert values(spark, ["ﬁne STRASSE Straße", None], stem.nfkc_fold) == [unicodedata.normalize("NFKC", "ﬁne strasse strasse"), None]


def test_html():
    page = "<head><title>t</title></head><nav>menu</nav><h1>A &amp; B</h1><p>x<sup>2</sup> <b>bold</b><p>open <a href='u'>link</a><ul><li>one<li>two</ul><script>no</script>"
    assert html.read_html(page, True) == "# A & B\n\nx^2 **bold**\n\nopen [link](u)\n\n- one\n- two"
    assert "menu" not in html.read_html(page, False) and html.read_html(None, False) is None
    assert html.read_html("<table><tr><td>a<td>b</tr><tr><td>c</table>", False) == "a | b\n\nc"


def test_sections_and_locators(spark):
    docs = spark.createDataFrame([("d", "intro\n# One\ntext a\n## Example\nb\n## Example\nc\n# Chapter 10\nd\n# Chapter 1\ne"), ("n", None)], "path string, text string")
    rows = sections.sections(docs, "path")
    got = {(r.path, r.sec_no): (r.level, r.heading, r.text) for r in rows.collect()}
    assert got["d", 0] == (0, "", "intro") and got["d", 2] == (2, "Example", "b") and got["n", 0] == (0, "", "")
    named = sections.unique_locators(rows, "path", "sec_no", "heading")
    assert {r.locator for r in named.where("path = 'd'").collect()} >= {"Example", "Example (2)", "Chapter 1"}
    found = sections.find_section(named, "path", "sec_no", "locator", "chapter 1").collect()
    assert [(r.path, r.text, r.tier) for r in found] == [("d", "e", 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2600), min_size=1, max_size=8))
def test_chunks_keep_every_paragraph(sizes):
    parts = [("w" * 7 + " ") * (n // 8) + "end" for n in sizes]
    chunks = sections.pack("\n\n".join(parts))
    assert all(len(c) <= sections.LONGEST + sections.OVERLAP + 2 for c in chunks)
    assert sum(c.count("end") for c in chunks) >= len(parts)


def test_pack_edges():
    assert sections.pack(None) == [] and sections.pack("short") == ["short"]
    assert len(sections.pack("a" * 4000)) == 3


def test_reading_view_and_tables(spark):
    page = "Original file: x.pdf\n> Visual content: chart or diagram. View the slide image for exact details.\n[Slide 1 image 2](a.assets/p.png)\n\n\n\nend"
    assert values(spark, [page], text.reading_view) == ["> Visual: chart or diagram\nSlide 1 image 2\n\nend"]
    assert values(spark, ["a|b\nc"], lambda c: text.markdown_row(c, F.lit(None))) == ["| a\\|b c |  |"]


def test_pages_of_a_batch_are_read_some_at_a_time():
    import tracemalloc

    import pyarrow as pa

    page = "<p>" + "word " * 4000 + "</p>"
    batch = pa.array([page, None, ""] * 400)
    tracemalloc.start()
    found = html.read_pages(batch, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [html.read_html(page, True), None, ""] * 400
    assert peak < 6_000_000  # all pages and texts at once are 16 MB
    assert html.read_pages(pa.array([], pa.string()), False).to_pylist() == []
