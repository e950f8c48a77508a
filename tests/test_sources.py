import json
import zipfile

from pyspark.sql import functions as F

from lectern.sources import captions, files
from lectern.sources.paged import PagedJson

VTT = "WEBVTT\n\n1\n00:01.500 --> 00:03.000 align:start\n<v A>so we</v> &amp; they\n\n00:00:59,000 --> 00:01:02,000\nlate\n\n01:00:00.000 --> 01:00:01.000\n\n"


def test_captions(spark):
    rows = captions.segments(spark.createDataFrame([("m", VTT), ("n", None)], "id string, t string"), "id", "t")
    assert [(r.start, r.end, r.text) for r in rows.orderBy("start").collect()] == [(1.5, 3.0, "so we & they"), (59.0, 62.0, "late")]
    assert [r.text for r in captions.transcript(rows, "id").collect()] == ["so we & they late"]
    tracks = spark.createDataFrame([("m", "fr", "subtitles", 1), ("m", "en-US", "captions", 2), ("m", "en", "subtitles", 3)], "id2 string, locale string, kind string, id int")
    assert captions.preferred_track(tracks, "id2").first().id == 3


def test_kinds(spark):
    rows = spark.createDataFrame([("a/B.PDF", None), ("x.ipynb", None), ("noext", "image/png"), ("noext", None), ("t.csv", "text/plain")], "p string, m string")
    assert [r[0] for r in rows.select(files.kind_of(F.col("p"), F.col("m"))).collect()] == ["pdf", "notebook", "image", "unknown", "csv"]


def test_markdown_tree(spark, tmp_path):
    for name in ("a/one.md", "a/.hidden/no.md", "a/x.assets/no.md", "_Packs/no.md", "b c/two.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('---\ntitle: "T: x"\nkind: page\n---\nbody\n')
    rows = files.markdown_files(spark, f"file://{tmp_path}", ("_Packs",))
    meta, body = files.front_matter(F.col("text"))
    got = {r.path: (r.meta, r.body) for r in rows.select("path", meta.alias("meta"), body.alias("body")).collect()}
    assert got == {p: ({"title": "T: x", "kind": "page"}, "body\n") for p in ("a/one.md", "b c/two.md")}
    assert rows.select(files.emit_front_matter(meta)).first()[0] == "---\nkind: page\ntitle: T: x\n---\n"


def test_notebook_zip_and_delimited(spark, tmp_path):
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "markdown", "source": "# t"}, {"cell_type": "code", "source": []}]})
    cells = files.notebook_cells(spark.createDataFrame([("n", book)], "id string, t string"), "id", "t")
    assert [(r.cell_no, r.source) for r in cells.orderBy("cell_no").collect()] == [(0, "a\nb"), (1, "# t")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.txt", "hello")
        z.writestr("../evil.txt", "no")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    got = files.zip_members(spark, f"file://{tmp_path}/*.zip").collect()
    assert [(r.member, r.size, bytes(r.content)) for r in got if r.error is None] == [("in/x.txt", 5, b"hello")]
    assert sorted((r.member or "", r.error) for r in got if r.error) == [("", "unreadable archive"), ("../evil.txt", "leaves the archive")]
    assert [r.error for r in files.zip_members(spark, f"file://{tmp_path}/a.zip", most=1).collect()] == ["too many members"]
    tables = files.delimited_tables(spark.createDataFrame([("f", "a;b\n1;2\n"), ("e", None)], "id string, t string"), "id", "t")
    assert [(r.cells, r.delimiter) for r in tables.orderBy("row_no").collect()] == [(["a", "b"], ";"), (["1", "2"], ";")]


def test_delimited_counts_what_it_leaves_out(spark):
    body = "\n".join(",".join(str(c) for c in range(5)) for _ in range(10))
    got = files.delimited_tables(spark.createDataFrame([("f", body)], "id string, t string"), "id", "t", most_rows=2, most_columns=3).collect()
    assert [(r.row_no, r.cells, r.rows, r.columns, r.cut) for r in got] == [(i, ["0", "1", "2"], 10, 5, False) for i in range(2)]


def test_text_json_and_listing(spark, tmp_path):
    (tmp_path / "a.py").write_text("print(1)\n")
    (tmp_path / "n.json").write_text('[{"k": 1}, {"k": 2}]')
    got = {r.path.rsplit("/", 1)[1]: (r.language, r.text, r.cut) for r in files.text_files(spark, f"file://{tmp_path}", most=20).collect()}
    assert got["a.py"] == ("python", "```python\nprint(1)\n```", False)
    assert [r.k for r in files.json_store(spark, f"file://{tmp_path}/n.json").orderBy("k").collect()] == [1, 2]
    rows = [("b.md", False), ("Alpha", True), ("a.md", False), (".git", True), ("deck.assets", True), ("zed", True)]
    assert [r.name for r in files.folder_listing(spark.createDataFrame(rows, "name string, is_folder boolean")).collect()] == ["Alpha", "zed", "a.md", "b.md"]


def test_write_if_changed(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    assert files.write_if_changed(rows, target, "k", "v").count() == 2
    assert files.write_if_changed(rows, target, "k", "v").count() == 0
    changed = files.write_if_changed(spark.createDataFrame([("a", "9"), ("b", "2")], "k string, v string"), target, "k", "v")
    assert [(r.k, r.version) for r in changed.collect()] == [("a", 2)]


def test_paged_listing(spark, tmp_path):
    for listing, pages in {"files": [[1, 2], [3]], "pages": [[4]]}.items():
        (tmp_path / listing).mkdir()
        for n, ids in enumerate(pages, 1):
            body = {"items": [{"id": i, "at": "2024-01-01T00:00:00Z"} for i in ids], "next": n + 1 if n < len(pages) else None}
            (tmp_path / listing / f"{n}.json").write_text(json.dumps(body))
    spark.dataSource.register(PagedJson)
    rows = spark.read.format("paged_json").schema("listing string, id long, at timestamp").option("path", f"file://{tmp_path}").load()
    assert sorted((r.listing, r.id) for r in rows.collect()) == [("files", 1), ("files", 2), ("files", 3), ("pages", 4)]


def _zip(parts):
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office(spark):
    w, a, p, s, r = (f'xmlns:{k}="http://schemas.openxmlformats.org/{v}"' for k, v in {
        "w": "wordprocessingml/2006/main", "a": "drawingml/2006/main", "p": "presentationml/2006/main", "s": "spreadsheetml/2006/main", "r": "officeDocument/2006/relationships"
    }.items())
    rels = lambda *t: "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{x}"/>' for i, x in enumerate(t, 1)) + "</Relationships>"
    word = _zip({"word/document.xml": f'<w:document {w}><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t><w:t>b</w:t></w:r></w:p></w:document>'})
    slide = lambda *t: f"<p:sld {p} {a}>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</p:sld>"
    deck = _zip({"ppt/presentation.xml": f'<p:presentation {p} {r}><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:presentation>', "ppt/_rels/presentation.xml.rels": rels("slides/slide1.xml", "slides/slide2.xml"),
                 "ppt/slides/slide1.xml": slide("Last", "x"), "ppt/slides/slide2.xml": slide("First")})
    book = _zip({"xl/workbook.xml": f'<s:workbook {s} {r}><s:sheet name="S" r:id="r1"/></s:workbook>', "xl/_rels/workbook.xml.rels": rels("worksheets/sheet1.xml"),
                 "xl/sharedStrings.xml": f"<s:sst {s}><s:si><s:t>head</s:t></s:si></s:sst>",
                 "xl/worksheets/sheet1.xml": f'<s:worksheet {s}><s:row><s:c r="A1" t="s"><s:v>0</s:v></s:c><s:c r="C1"><s:v>2.5</s:v></s:c></s:row></s:worksheet>'})
    from lectern.sources.office import office_text

    files_in = spark.createDataFrame([("w", "document", word), ("d", "slides", deck), ("b", "spreadsheet", book), ("x", "slides", b"no")], "id string, kind string, content binary")
    got = {r.id: (r.text, r.error) for r in office_text(files_in, "id", "kind", "content").collect()}
    assert got == {"w": ("# Top\n\na b", None), "d": ("## [Slide 1] First\n\n## [Slide 2] Last\nx", None), "b": ("## [Sheet: S]\nhead |  | 2.5", None), "x": (None, "BadZipFile")}
