import pytest
from pyspark.sql import functions as F

from lectern.functions import predicates
from lectern.operators import records


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_lookup_through_asset_folders(spark):
    docs = frame(spark, [("a/f.pdf.assets/p1.png",), ("a/g.pdf",), ("b/x",)], "path string")
    items = frame(spark, [("c1", "i2", 2, "a/f.pdf", None), ("c1", "i1", 1, "a/f.pdf", "a/g.pdf"), ("c2", "i9", 1, "a/g.pdf", None)], "course string, item string, position int, path string, text string")
    assert {tuple(r) for r in records.record_items(docs, items).collect()} == {("a/f.pdf.assets/p1.png", "c1", "i1"), ("a/g.pdf", "c1", "i1"), ("a/g.pdf", "c2", "i9")}


def test_status_precedence(spark):
    docs = frame(spark, [("_Removed from Canvas/a", None), ("b", "stale"), ("c", None), ("d", None), ("e", "stale")], "path string, marker string")
    known = frame(spark, [("_Removed from Canvas/a", "ok", False, False), ("c", "failed", False, False), ("d", "ok", False, True), ("e", "ok", False, False)], "path string, status string, stale boolean, locked boolean")
    got = records.material_status(docs, known, predicates.is_removed(F.col("path")))
    assert {r.path[-1]: r.availability for r in got.collect()} == {"a": "removed", "b": "stale", "c": "stale", "d": "restricted", "e": "current"}


def test_scope_and_priority(spark):
    links = frame(spark, [("m1", "a"), ("m2", "a"), ("m2", "b")], "module string, path string")
    got = records.in_scope(links, frame(spark, [("a",), ("b",), ("c",)], "path string"), frame(spark, [("m1",)], "module string"))
    assert {r.path: r.in_scope for r in got.collect()} == {"a": True, "b": False, "c": True}
    rows = frame(spark, [(1, "x"), (2, "y"), (3, "z")], "id int, name string")
    found = records.first_of(rows, ["id", "name"], [frame(spark, [(1, "by id")], "id int, v string"), frame(spark, [("x", "n"), ("y", "by name")], "name string, v string")], "v")
    assert {r.id: r.v for r in found.collect()} == {1: "by id", 2: "by name", 3: None}


def test_aliases_and_tokens(spark):
    rows = frame(spark, [("m", "file", 1, ["wk1"]), ("m", "object", 2, ["wk2", "wk1"]), ("n", "one", 1, ["x"])], "entry string, name string, prio int, contexts array<string>")
    got = {r.entry: (r.name, r.aliases, r.contexts) for r in records.merge_aliases(rows, "entry", "contexts", F.col("prio")).collect()}
    assert got == {"m": ("file", ["object"], ["wk1", "wk2"]), "n": ("one", [], ["x"])}
    docs = frame(spark, [("d", "see [a](canvas-file:7), [b](canvas-page:x) and [c](http://u)"), ("e", "none")], "path string, text string")
    targets = frame(spark, [("canvas-file", "7", "files/a.pdf")], "kind string, id string, target string")
    assert {r.path: r.text for r in records.resolve_tokens(docs, targets, "path", "text").collect()} == {
        "d": "see [a](files/a.pdf), [b](canvas-page:x) and [c](http://u)", "e": "none"
    }


def test_locators(spark):
    sections = frame(spark, [("d", 0, "[Slide 3] Duration"), ("d", 1, "Example"), ("d", 2, "example:"), ("d", 3, "[Page 4]")], "path string, sec_no int, locator string")
    cites = frame(spark, [("d", "slide 3"), ("d", "Slide 3 Duration"), ("d", "Example"), ("d", "page 4"), ("d", "nope")], "path string, locator string")
    got = {r.locator: (r.sec_no, r.error) for r in records.by_locator(cites, sections).collect()}
    assert got == {"slide 3": (0, None), "Slide 3 Duration": (0, None), "Example": (None, "ambiguous_locator"), "page 4": (3, None), "nope": (None, "missing_locator")}


def join_rows(df):
    """The most rows that a join of a frame's plan gives."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName().startswith("Adaptive"):
            todo.append(plan.executedPlan())
            continue
        if "QueryStage" in plan.nodeName():
            todo.append(plan.plan())
            continue
        if "Join" in plan.nodeName():
            most = max(most, plan.metrics().apply("numOutputRows").value())
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


def test_a_name_of_many_sections_meets_its_citations_once(spark):
    same = spark.range(300).selectExpr("'d' AS path", "id AS sec_no", "'Example' AS locator")
    cites = spark.range(200).selectExpr("id AS cite", "'d' AS path", "'example' AS locator").unionByName(frame(spark, [(200, None, "example")], "cite long, path string, locator string"))
    found = records.by_locator(cites, same)
    assert found.columns == ["cite", "path", "locator", "error", "sec_no"]
    assert join_rows(found) <= 201
    assert {(r.error, r.sec_no): r["count"] for r in found.groupBy("error", "sec_no").count().collect()} == {("ambiguous_locator", None): 200, ("missing_locator", None): 1}


def test_as_of(spark):
    rows = frame(spark, [("k", 5), ("k", 10), ("k", 1), ("z", 9)], "key string, at int")
    versions = frame(spark, [("k", 5, "v5"), ("k", 7, "v7"), ("k", 11, "v11")], "key string, since int, name string")
    got = {(r.key, r.at): r.version and r.version.name for r in records.as_of(rows, versions, "key", "at", "since").collect()}
    assert got == {("k", 5): "v5", ("k", 10): "v7", ("k", 1): None, ("z", 9): None}


def test_summaries_boxes_and_retries(spark):
    saved = frame(spark, [("s", {"a": "1", "b": "2"}, 10), ("t", {"a": "1"}, 1)], "summary string, saved map<string,string>, written int")
    now = frame(spark, [("s", "a", "1", 5), ("s", "b", "2", 9), ("t", "a", "1", 3)], "summary string, path string, fingerprint string, updated int")
    assert {r.summary: r.state for r in records.summary_state(saved, now).collect()} == {"s": "current", "t": "changed"}
    labels = frame(spark, [(1, "in", 0.5, 0.5), (1, "near", 1.2, 0.5), (1, "out", 4.0, 4.0)], "page int, label string, cx double, cy double")
    boxes = frame(spark, [(1, "big", -5.0, -5.0, 6.4, 6.4), (1, "small", 0.0, 0.0, 1.0, 1.0)], "page int, box string, x double, y double, w double, h double")
    assert {r.label: r.box for r in records.labels_in_boxes(labels, boxes, "page").collect()} == {"in": "small", "near": "small"}
    tries = frame(spark, [("a", "s1", i, False) for i in range(3)] + [("b", "s1", 0, False), ("b", "s2", 1, False), ("c", "s", 0, False), ("c", "s", 1, True), ("c", "s", 2, False)], "key string, stamp string, at int, ok boolean")
    assert {r.key: (r.misses, r.give_up) for r in records.retry_budget(tries, "key").collect()} == {"a": (3, True), "b": (1, False), "c": (1, False)}


def test_incremental_index_rebuilds_changes_only(spark):
    old = frame(spark, [("a", "1", "A"), ("b", "1", "B"), ("c", "1", "C")], "path string, stamp string, chunk string")
    files = frame(spark, [("a", "1"), ("b", "2"), ("d", "1")], "path string, stamp string")
    got = records.incremental_index(old, files, "path", "stamp", lambda f: f.withColumn("chunk", F.concat(F.lit("new "), "path")))
    assert {r.path: r.chunk for r in got.collect()} == {"a": "A", "b": "new b", "d": "new d"}


def test_detail_view(spark):
    rows = frame(spark, [(1, "q", "secret"), (2, "r", "secret"), (3, "s", "x")], "id int, prompt string, answer string")
    got = records.detail_view(rows, "id", [3, 1, 3], ["answer"])
    assert [r.id for r in got.collect()] == [3, 1] and got.columns == ["id", "prompt"]
    with pytest.raises(ValueError, match="at most"):
        records.detail_view(rows, "id", range(60))


def test_predicates(spark):
    texts = ["The final value of the bond", "The final will be cumulative.", "Make sure you know this", "plain", "a=b\nc=d\ne=f", "∑ ∫ ∂"]
    rows = frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    pick = lambda c: [r[0] for r in rows.select(c).collect()]
    assert pick(predicates.speaks_of_exam(F.col("t")))[:4] == [False, True, False, False]
    assert pick(predicates.is_emphatic(F.col("t")))[:4] == [False, False, True, False]
    assert pick(predicates.is_mathy(F.col("t"))) == [False, False, False, False, True, True]
    assert predicates.kinds("lectures, pdf weird") == ["transcript", "pdf", "weird"]
    courses = frame(spark, [("1", "Finance A", "FIN-1", "Finance_A"), ("2", "Finance X", "FIN-2", "FinanceXA")], "id string, name string, code string, folder string")
    assert [r.folder for r in predicates.course_folders(courses, "Finance_A").collect()] == ["Finance_A"]
    assert [r.folder for r in predicates.course_folders(courses, "fin 2").collect()] == ["FinanceXA"]
    docs = frame(spark, [("Finance_A/x.md",), ("FinanceXA/y.md",)], "path string")
    assert [r.path for r in predicates.in_course(docs, predicates.course_folders(courses, "Finance_A")).collect()] == ["Finance_A/x.md"]


def test_courses_and_states(spark):
    from lectern.operators import changes

    courses = frame(spark, [("1", "Bonds", "B", "f1"), ("2", "bonds", "C", "f2"), ("3", "Stocks", "S", "Bonds")], "id string, name string, code string, folder string")
    pick = lambda w: [r.id for r in predicates.one_course(courses, w).collect()]
    assert pick("Bonds") == ["3"] and pick("s") == ["3"] and pick("BONDS") == [] and pick("none") == []
    listings = frame(spark, [("f", True), ("p", False)], "kind string, complete boolean")
    old, new = frame(spark, [(1, "f"), (2, "p")], "k int, kind string"), frame(spark, [(3, "f"), (4, "p")], "k int, kind string")
    assert {r.k for r in changes.keep_last_good(old, new, listings, "kind").collect()} == {3, 2}
    runs = frame(spark, [("a", 1, True), ("a", 2, False), ("b", 1, False), ("c", 2, True)], "k string, at int, ok boolean")
    assert {r.k: r.state for r in changes.last_state(runs, "k", "at", "ok").collect()} == {"a": "stale", "b": "failed", "c": "current"}
