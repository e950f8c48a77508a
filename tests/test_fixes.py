from pyspark.sql import functions as F

import pytest

from lectern.functions import names, predicates
from lectern.operators import records, retrieval, sections
from lectern.plans import retrieval as plans
from lectern.sources import files


def test_front_matter_repeated_keys_and_escapes(spark):
    text = '---\ntitle: "A \\"b\\" \\u00e9"\ntype: page\ntitle: other\n---\nbody'
    meta, body = files.front_matter(F.col("t"))
    got = spark.createDataFrame([(text,), ("plain",), (None,)], "t string").select(meta.alias("m"), body.alias("b")).collect()
    assert got[0].m == {"title": 'A "b" é', "type": "page"} and got[0].b == "body" and got[1].m is None and got[1].b == "plain"


def test_course_filter_keeps_equal_rows_and_takes_words_literally(spark):
    docs = spark.createDataFrame([("A/x.md", 1), ("A/x.md", 1), ("A/B/y.md", 2), ("C%/z.md", 3), ("D/week_1.md", 4)], "path string, n int")
    folders = spark.createDataFrame([("A",), ("A/B",)], "folder string")
    assert sorted(r.n for r in predicates.in_course(docs, folders).collect()) == [1, 1, 2]
    courses = spark.createDataFrame([("1", "Alpha", "AL-1", "A")], "id string, name string, code string, folder string")
    pick = lambda w: sorted(r.n for r in predicates.filter_course(docs, courses, w).collect())
    assert pick("alpha") == [1, 1, 2] and pick("C%") == [3] and pick("week_1") == [4] and pick("nothing") == []


def test_text_sniff(spark):
    rows = [b"plain", b"a\0b", b"\xff\xfe", ("é" * 4000).encode(), b"x" + ("é" * 4000).encode(), b"", b"\x10\x01", b"a" * 4095 + b"\xc3"]
    frame = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rows)], "i int, c binary")
    assert [r[0] for r in frame.orderBy("i").select(predicates.looks_like_text(F.col("c"))).collect()] == [True, False, False, True, True, True, True, False]


def test_token_resolution_keeps_every_text(spark):
    rows = [(1, "see (canvas-file:7) and (canvas-page:x)!"), (2, None), (3, "(canvas-file: open \u0001 text"), (4, "(canvas-file:7)"), (5, "")]
    targets = spark.createDataFrame([("canvas-file", "7", "files/a.pdf")], "kind string, id string, target string")
    got = {r.d: r.t for r in records.resolve_tokens(spark.createDataFrame(rows, "d int, t string"), targets, "d", "t").collect()}
    assert got == {1: "see (files/a.pdf) and (canvas-page:x)!", 2: None, 3: rows[2][1], 4: "(files/a.pdf)", 5: ""}


def test_query_bounds():
    assert retrieval.bounded_queries("bond price", ["Price BOND", "yield curve"]) == [["bond", "price"], ["yield", "curve"]]
    assert retrieval.bounded_queries("bond", limit=0) == []
    for bad in (["a"] * 5, [" "], ["x" * 513]):
        with pytest.raises(ValueError):
            retrieval.bounded_queries("bond", bad)


def test_chunks_of_titled_sections(spark):
    assert sections.pack("", "Title", 2) == ["Title"] and sections.pack("", "Title", 1) == [] and sections.pack("text", "Title", 2) == ["Title\n\ntext"]
    long = "Sentence one is here. " * 120
    chunks = sections.pack(long, "Head", 2)
    assert chunks[0].startswith("Head\n\nSentence") and all(len(c) <= sections.LONGEST for c in chunks)
    assert all(b.startswith(a[-sections.OVERLAP :]) for a, b in zip(chunks, chunks[1:], strict=False))
    docs = spark.createDataFrame([(1, "# One\n\nfirst\n\n## Two\n\nsecond", "Doc"), (2, None, "Empty")], "d int, text string, name string")
    got = [(r.d, r.title, r.chunk) for r in sections.chunks(docs, "d", title="name").orderBy("d", "sec_no", "chunk_no").collect()]
    assert got == [(1, "Doc", "One\n\nfirst"), (1, "", "Two\n\nsecond")]


def test_retrieval_quality_of_short_and_quoted_passages(spark, tmp_path):
    docs = [(1, 'He said "alpha beta gamma delta epsilon zeta eta theta" today'), (2, "one two"), (3, "x one two three y"), (4, None)]
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "one two"), (3, "two"), (4, "one two three"), (5, "not there at all")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.documents, r.first_doc) for r in plans.retrieval_quality(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 2), 4: (1, 3), 5: (0, None)}


def test_exam_titles_boilerplate_and_courses(spark):
    frame = spark.createDataFrame([("Midterm 2",), ("Testing methods",), (None,), ("Quiz",)], "t string")
    assert [r[0] for r in frame.select(predicates.is_exam(F.col("t"))).collect()] == [True, False, False, True]
    text = spark.createDataFrame([("keep\nOriginal file: x\n- **Due:** now\nend",)], "t string")
    assert text.select(predicates.without_boilerplate(F.col("t"))).first()[0] == "keep\nend"
    rows = [("1", "Finance", "F1", True, False), ("2", "Art", "A1", True, True), ("3", "Music", "M1", False, False), ("4", "Fine art", "X", True, None)]
    courses = spark.createDataFrame(rows, "id string, name string, code string, active boolean, restricted boolean")
    pick = lambda **k: [r.id for r in predicates.selected_courses(courses, **k).orderBy("id").collect()]
    assert pick() == ["1", "4"] and pick(only=("3",)) == ["3"] and pick(excluded=("1",)) == ["4"] and pick(named="fin") == ["1", "4"]


def test_names(spark):
    frame = spark.createDataFrame([(' a/b: "c"?. ', "x\r\n\r\n\r\n\r\ny \n\x07z  "), ("...", None)], "n string, t string")
    got = [tuple(r) for r in frame.select(names.safe_name(F.col("n")), names.clean_text(F.col("t")), names.inline(F.col("t"))).collect()]
    assert got == [("a b c", "x\n\ny\nz", "x y z"), ("untitled", "", "")]
    text = "a" * 300 + "needle" + "b" * 300
    shown = spark.createDataFrame([(text,)], "t string").select(names.window_around(F.col("t"), F.lit(300))).first()[0]
    assert "needle" in shown and shown[0] == shown[-1] == "…" and len(shown) <= 322
    entries = spark.sql("SELECT array(struct('k' AS key, 1 AS value), struct('k' AS key, 2 AS value)) AS e")
    assert entries.select(names.first_wins(F.col("e"))).first()[0] == {"k": 1}


def test_names_of_files(spark):
    cases = {
        "nul": "_nul", "Com1.tar.gz": "_Com1.tar.gz", "console": "console", " .x. ": "x", None: "untitled", "a\u00a0\u2028 b": "a b",
        "x" * 200: "x" * 110, "x" * 200 + ".pdf": "x" * 106 + ".pdf", "x" * 200 + ".notanextension": "x" * 110,
        "漢" * 90: "漢" * 66, "漢" * 90 + ".docx": "漢" * 65 + ".docx", "y" * 105 + ". . " + "z" * 9 + ".md": "y" * 105 + ".md",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "n string").select("n", names.safe_name(F.col("n")).alias("got"))
    assert {r.n: r.got for r in frame.collect()} == cases


def test_clean_text(spark):
    text = "ﬁn\u00ad al\u200b  \r\nhyphen-\nated Non-\nBreak\u2028 \u00a0\x0b\x0c\n  # head # two\n#\nend \t"
    got = spark.createDataFrame([(text,)], "t string").select(names.clean_text(F.col("t"))).first()[0]
    assert got == "fin al\nhyphenated Non-\nBreak\n\n  \\# head # two\n\\#\nend"
