import sqlite3
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import changes, coverage, folds, practice, retrieval

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(st.sets(st.integers(1, 40), min_size=1))
def test_islands(spark, numbers):
    frame = spark.createDataFrame([("k", n) for n in numbers], "k string, n int")
    runs = sorted((r["first"], r["last"]) for r in coverage.islands(frame, ["k"], "n").collect())
    assert sorted(n for a, b in runs for n in range(a, b + 1)) == sorted(numbers)
    assert all(b[0] > a[1] + 1 for a, b in zip(runs, runs[1:], strict=False))


def plain_schedule(attempts):
    streak, due = 0, None
    for at, rating in sorted(attempts):
        if rating == "good":
            streak = streak + 1 if due is None or at >= due else max(1, streak)
            due = at + practice.GOOD_DAYS[min(streak, 5) - 1] * 86400
        else:
            streak, due = 0, at + (86400 if rating == "hard" else 600)
    return streak, due


@few
@given(st.lists(st.tuples(st.integers(0, 40 * 86400), st.sampled_from(["good", "hard", "again"])), min_size=1, max_size=20))
def test_schedule(spark, attempts):
    frame = spark.createDataFrame([("q", a, r) for a, r in attempts], "q string, at long, rating string")
    got = practice.review_schedule(frame, "q", "at", "rating").first()
    assert (got.streak, got.due) == plain_schedule(attempts)


def test_rapid_retries_and_days(spark):
    rows = [("rapid", i, "good") for i in range(10)] + [("days", 0, "again"), ("days", 600, "good"), ("days", 600 + 86400, "good")]
    got = {r.q: (r.streak, r.due) for r in practice.review_schedule(spark.createDataFrame(rows, "q string, at long, rating string"), "q", "at", "rating").collect()}
    assert got["rapid"][0] == 1 and got["days"] == (2, 600 + 86400 + 3 * 86400)


def test_accuracy(spark):
    rows = [("q", i, c) for i, c in enumerate([True, False, True, True])]
    got = practice.accuracy(spark.createDataFrame(rows, "q string, n long, ok boolean"), "q", "n", "ok").first()
    assert (got["first"], got.latest, got.recent, got.attempts) == (1.0, 1.0, 0.75, 4)


@pytest.mark.parametrize(
    ("answer", "correct", "problem"),
    [("The answer is a higher bond price", 1, None), ("The answer is (a)", 1, "names another choice"), ("B", 1, None), ("a lower bond yield", 1, "words of another choice"), ("x", 9, "no such choice")],
)
def test_answer_keys(spark, answer, correct, problem):
    frame = spark.createDataFrame([(answer, ["lower bond yield", "higher bond price"], correct)], "a string, c array<string>, k int")
    assert frame.select(practice.answer_key_problem(F.col("a"), F.col("c"), F.col("k"))).first()[0] == problem


def test_quotes(spark):
    sources = spark.createDataFrame([("d", "It’s a **bond**, and it… pays [well](u).")], "path string, text string")
    quotes = [("d", "it's a bond"), ("d", "it... pays well"), ("d", "other"), ("x", "bond"), ("d", "**"), ("d", ".")]
    got = practice.validate_quotes(spark.createDataFrame(quotes, "path string, quote string"), sources, "quote", "text", "path")
    want = {"it's a bond": None, "it... pays well": None, "other": "quote_mismatch", "bond": "missing_source", "**": "invalid_citation", ".": "invalid_citation"}
    assert {r.quote: r.error for r in got.collect()} == want


def test_bm25_agrees_with_a_full_text_index(spark):
    """An independent index (SQLite FTS5) ranks and scores the same."""
    docs = [(i, "alpha beta" if i % 5 == 0 else "title", " ".join(["alpha"] * (i % 3) + ["gamma"] * (i % 4) + ["filler"] * (i % 7 + 1))) for i in range(30)]
    base = sqlite3.connect(":memory:")
    base.execute("CREATE VIRTUAL TABLE c USING fts5(text, title)")
    base.executemany("INSERT INTO c(rowid, text, title) VALUES (?, ?, ?)", [(i + 1, t, h) for i, h, t in docs])
    want = {r - 1: -s for r, s in base.execute("SELECT rowid, bm25(c, 1.0, 3.0) FROM c WHERE c MATCH 'alpha OR gamma'")}
    frame = spark.createDataFrame(docs, "i int, title string, text string")
    counted = retrieval.term_counts(frame, ["i"], ["alpha", "gamma"])
    got = {r.i: r.score for r in retrieval.bm25(counted, retrieval.corpus_statistics(counted, 2), 2).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_fusion_caps_and_phrases(spark):
    docs = [(f"d{i}", "", "duration " * 3) for i in range(3)] + [(f"c{i}", "", "convexity " * 3) for i in range(3)] + [("both", "", "duration and convexity")]
    frame = spark.createDataFrame(docs, "path string, title string, text string")
    hits = retrieval.search(frame, "path", [["duration"], ["convexity"]]).orderBy(F.desc("fused"), "path").collect()
    assert hits[0].path == "both" and hits[0].queries == [0, 1] and len(hits) == 7
    only = retrieval.search(frame, "path", [["duration"]], where=F.col("path") != "d0").collect()
    assert {h.path for h in only} == {"d1", "d2", "both"}
    phrase = retrieval.search(frame, "path", [["duration and"]]).collect()
    assert [h.path for h in phrase] == ["both"]
    capped = retrieval.capped(spark.createDataFrame([("a", i) for i in range(9)], "g string, i int"), "g", [F.desc("i")], 3)
    assert {r.i for r in capped.collect()} == {6, 7, 8}


def test_snapshot_and_sweep(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, s string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, s string")
    assert {r.k: r.change for r in changes.snapshot_diff(old, new, "k", "s").collect()} == {1: "delete", 2: "update", 3: "unchanged", 4: "insert"}
    items = spark.createDataFrame([(1, "f", False), (2, "f", False), (3, "p", False), (4, "f", True)], "k int, kind string, removed boolean")
    listings = spark.createDataFrame([("f", True), ("p", False)], "kind string, complete boolean")
    swept = changes.mark_and_sweep(items, spark.createDataFrame([(1,), (4,)], "k int"), listings, "k", "kind")
    assert {r.k: r.state for r in swept.collect()} == {1: "seen", 2: "removed", 3: "kept", 4: "restored"}


def test_claims_and_moves(spark):
    names = spark.createDataFrame([(1, "A.md"), (2, "a.MD"), (3, "b")], "k int, p string")
    assert {r.k: r.claimed for r in changes.claim_paths(names, "k", "p").collect()} == {1: "A.md", 2: "a (2).MD", 3: "b"}
    moves = spark.createDataFrame([("x", "y"), ("x/a", "z")], "old string, new string")
    moved = changes.move_keys(spark.createDataFrame([("x/a/f",), ("x/b",), ("xa",)], "p string"), moves, "p")
    assert {r.p: r.moved for r in moved.collect()} == {"x/a/f": "z/f", "x/b": "y/b", "xa": "xa"}


def test_folds(spark):
    rows = spark.createDataFrame([("m", i, t) for i, t in enumerate(["so", "so we", "we", "go on", "go on", None])], "k string, i int, t string")
    assert [(r.i, r.t) for r in folds.collapse_captions(rows, "k", "i", "t").orderBy("i").collect()] == [(0, "so we"), (3, "go on")]
    frames = spark.createDataFrame([("v", i, float(v)) for i, v in [(0, 0), (3, 50), (7, 60), (8, 100), (20, 90)]], "k string, at int, v double")
    assert [r.at for r in folds.key_frames(frames, "k", "at", "v", 12.0, 6).orderBy("at").collect()] == [0, 7, 20]


def test_progress_and_headers(spark):
    rows = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "x", True)], "c string, m string, done boolean")
    got = {(r.c, r.m): (r.total, r.done, r.complete) for r in coverage.progress(rows, ["c", "m"], "done").collect()}
    assert got[None, None] == (3, 2, False) and got["b", None] == (1, 1, True)
    lines = spark.createDataFrame([("d", "head", p) for p in range(4)] + [("d", f"only {p}", p) for p in range(4)], "d string, line string, page int")
    assert [r.line for r in coverage.frequent_lines(lines, "d", "line", "page", 3, 0.3).collect()] == ["head"]
    assert Counter(r.group for r in coverage.gap_groups(spark.createDataFrame([("k", t) for t in (0, 5, 20, 26)], "k string, t int"), ["k"], "t", 10).collect()) == {0: 2, 1: 2}


def test_gaps_between_numbers(spark):
    """As the expected numbers without those present, for repeated, null and low numbers and keys that are null."""
    rows = [(1, 1), (1, 4), (1, 4), (1, 7), (2, 3), (2, None), (3, None), (4, 0), (4, -2), (5, 1), (5, 2), (None, 2), (None, 4)]
    present = spark.createDataFrame(rows, "k int, n int")
    found = {tuple(r) for r in coverage.gaps(present, ["k"], "n").collect()}
    assert found == {(1, 2, 3), (1, 5, 6), (2, 1, 2), (None, 1, 1), (None, 3, 3)}
    assert coverage.gaps(present, ["k"], "n").schema.simpleString() == "struct<k:int,first:int,last:int>"
    worded = {tuple(r) for r in coverage.worded(coverage.gaps(present, ["k"], "n"), ["k"]).collect()}
    assert worded == {(1, "2-3, 5-6"), (2, "1-2"), (None, "1, 3")}
