from pyspark.sql import functions as F

from lectern.operators import sections, study, views

DECK = "# Deck\n## [Slide 1] Intro\nwords that are long enough to count as text\n## [Slide 2] Chart\n> Visual content: chart or diagram. View the slide image\n" "## [Slide 3]\nmore words that are long enough to count\n## [Slide 4]\nshort\n## [Slide 5] End\nagain words that are long enough here"


def test_units_and_missed(spark):
    docs = spark.createDataFrame([("d", DECK), ("e", "# no units")], "path string, text string")
    rows = study.units(sections.sections(docs, "path"))
    got = {r.num: (r.title, r.visual, r.has_text) for r in rows.collect()}
    assert got == {1: ("Intro", None, True), 2: ("Chart", "chart or diagram", False), 3: ("", None, True), 4: ("", None, False), 5: ("End", None, True)}
    notes = spark.createDataFrame([("d", "see Slides 1-2")], "path string, note string")
    assert [tuple(r) for r in study.missed_units(rows, notes).collect()] == [("d", "3, 5")]
    survey = study.visual_survey(rows).first()
    assert (survey.total, survey.described, [t.num for t in survey.todo]) == (1, 0, [2])


def test_status_walk_and_newest(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3"), ("e", "4")], "path string, fingerprint string")
    notes = spark.createDataFrame([("a", "1"), ("c", "old"), ("d", "3")], "path string, fingerprint string")
    missed = spark.createDataFrame([("d", "4")], "path string, units string")
    assert {r.path: r.state for r in study.study_status(docs, notes, missed).collect()} == {
        "a": "done", "b": "same content", "c": "changed", "d": "missing references", "e": "no notes"
    }
    modules = spark.createDataFrame([("x", 2), ("y", 1)], "path string, position int")
    linked = spark.createDataFrame([("y", 0), ("z", 5)], "path string, position int")
    assert [r.path for r in study.course_walk([modules, linked]).orderBy("source", "position").collect()] == ["y", "x", "z"]
    kept = study.newest_notes(spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "path string, date int, note string"))
    assert [r.note for r in kept.collect()] == ["new"]


def test_rubric_media_attention(spark):
    schema = "r array<struct<id: string, description: string, points: double, ratings: array<struct<id: string, description: string>>>>, a map<string, struct<points: double, rating_id: string, comments: string>>"
    rows = spark.createDataFrame([([("c1", "Clarity", 5.0, [("g", "Good")]), ("c2", "Depth", 2.5, [])], {"c1": (3.0, "g", " nice "), "x": (1.0, None, None)})], schema)
    assert rows.select(views.rubric_feedback(F.col("r"), F.col("a"))).first()[0] == ["Clarity: 3/5 (Good) - nice"]
    media = spark.createDataFrame([([("v", "video/mp4", 5, None), ("s", "audio/mp3", 9, None), ("t", "audio/mp3", 7, None), (None, "audio/x", 1, None)],)], "s array<struct<url: string, type: string, size: long, bitrate: long>>")
    assert media.select(views.media_source(F.col("s"))).first()[0] == "t"
    items = spark.createDataFrame([("c", "failed", "x"), ("c", "failed", "y"), ("c", "failed", "y"), ("c", "pending", None), ("d", "ok", None)], "course string, status string, error string")
    assert [tuple(r) for r in views.attention(items, "course").collect()] == [("c", 1, 3, "y")]


def test_reading_order_hits_and_pack(spark):
    boxes = [(1, 0.1, 0.1, 0.8, "title"), (1, 0.1, 0.2, 0.3, "l1"), (1, 0.6, 0.2, 0.3, "r1"), (1, 0.1, 0.3, 0.3, "l2"), (1, 0.05, 0.5, 0.9, "foot"), (1, 0.6, 0.6, 0.2, "r2")]
    got = views.reading_order(spark.createDataFrame(boxes, "page int, x double, y double, w double, text string"), "page")
    assert [r.text for r in got.orderBy("nth").collect()] == ["title", "l1", "l2", "r1", "foot", "r2"]
    hits = spark.createDataFrame([(1, "a", "Same  text"), (2, "b", "same text"), (3, "c", "other")], "rank int, path string, text string")
    assert {(r.path, tuple(r.also)) for r in views.grouped_hits(hits, "path", "text").collect()} == {("a", ("b",)), ("c", ())}
    docs = spark.createDataFrame([("x/f.pdf",), ("y/F.pdf",), ("z",)], "path string")
    links = spark.createDataFrame([("m1", "x/f.pdf"), ("m1", "y/F.pdf"), ("m2", "z")], "module string, path string")
    packed = views.export_manifest(docs, links, spark.createDataFrame([("m1",)], "module string"), "pack")
    assert sorted(r.target for r in packed.collect()) == ["pack/m1/F (2).pdf", "pack/m1/f.pdf"]
