"""Hints of exams, questions of a plan and slices of outlines, by plain examples."""

from pyspark.sql import functions as F

from lectern.operators import mining, questions
from lectern.operators.sections import outline_slice

HINTS = "course string, path string, kind string, date string, text string, trusted boolean, excerpt string"
THREAD = "# Prompt\nWill the midterm be hard?\n# Replies\n- **A** (Instructor)\n  The quiz is open-book.\n- **B**\n  I heard the exam is easy.\n- _(deleted)_ by C (Instructor)\n  no final exam here"


def hints(spark, rows):
    return mining.exam_hints(spark.createDataFrame([(*r, None) for r in rows], HINTS))


def test_hints(spark):
    rows = [
        ("c", "a", "Transcript", None, "Make sure you know this. We read the final report today. See [the exam](x.md) soon!", True),
        ("c", "b", "pdf", None, "Pay attention to this idea here. Original file: exam.pdf\nOriginal file: the exam\n- The Exam is on Friday\n- see the exam   soon!", True),
        ("c", "d1", "discussion", None, THREAD, False),
        ("d", "d2", "discussion", None, THREAD, None),
        ("e", "n", None, None, None, None),
        ("e", "m", None, None, "", None),
    ]
    got = [(r.course, r.path, r.excerpt, r.weight) for r in hints(spark, rows).orderBy("course", "path", "sec_no", "ord").collect()]
    assert got == [
        ("c", "a", "Make sure you know this.", 1), ("c", "a", "See the exam soon!", 1), ("c", "b", "Original file: exam.pdf", 1),
        ("c", "b", "The Exam is on Friday", 1), ("c", "d1", "- **A** (Instructor) The quiz is open-book.".strip(" -*"), 1), ("c", "d1", "_(deleted)_ by C (Instructor) no final exam here", 1),
        ("d", "d2", "Will the midterm be hard?", 1), ("d", "d2", "A** (Instructor) The quiz is open-book.", 1), ("d", "d2", "_(deleted)_ by C (Instructor) no final exam here", 1),
    ]
    assert hints(spark, []).count() == 0


def test_excerpt_and_weight(spark):
    long = "x" * 300 + " this is important for the exam " + "y" * 300
    row = hints(spark, [("c", "a", "page", None, long, True)]).first()
    at = long.index("the exam") if "on the exam" in long else long.index("exam")
    assert (row.weight, row.excerpt) == (2, "…" + long[at - 160 : at + 160].strip() + "…")


def test_shown(spark):
    rows = [("c", f"{i:03}", "slides", None, f"exam number {i:03} {'on the exam' if i == 159 else ''}", True) for i in range(160)]
    rows += [("c", f"n{d}", "announcement", f"2024-01-0{d}", f"the quiz of day {d}", True) for d in (1, 3, 2)] + [("c", "nx", "announcement", "soon", "the quiz of some day", True)]
    got = mining.shown_hints(hints(spark, rows)).orderBy("bucket", "place").collect()
    assert [r.path for r in got if r.bucket == "announcement"] == ["n3", "n2", "n1", "nx"]
    slides = [r for r in got if r.bucket == "slides"]
    assert [r.path for r in slides] == [f"{i:03}" for i in [*range(149), 159]] and {r.found for r in slides} == {160}


QUESTION = "question int, batch int, plan string, kind string, topic string, prompt string, answer string, explanation string, difficulty string, choices array<string>, correct int"


def asked(question, **own):
    base = {
        "question": question, "batch": question, "plan": "p", "kind": "mcq", "topic": "t", "prompt": "q?", "answer": "B", "explanation": "so",
        "difficulty": "recall", "choices": ["one", "two"], "correct": 1,
    }
    return tuple((base | own).values())


def found(spark, rows, cited):
    sources = [("good", "Some words of a source.", True, True), ("far", "Some words of a source.", False, True), ("old", "Some words of a source.", True, False)]
    return questions.validated(
        spark.createDataFrame(rows, QUESTION), spark.createDataFrame(cited, "question int, path string, quote string"),
        spark.createDataFrame(sources, "path string, text string, in_scope boolean, current boolean"),
    )


def test_problems_of_questions(spark):
    wrong = [
        ({}, None), ({"kind": "short_answer", "choices": None, "correct": None}, None), ({"kind": None}, "kind"), ({"topic": None}, "topic"), ({"topic": "x" * 201}, "topic"), ({"prompt": " \n"}, "prompt"),
        ({"answer": "a\x07"}, "answer"), ({"explanation": ""}, "explanation"), ({"difficulty": "hard"}, "difficulty"), ({"choices": ["one"]}, "choices"), ({"choices": None}, "choices"),
        ({"correct": 2}, "choices"), ({"correct": None}, "choices"), ({"choices": ["one", " "]}, "choice"), ({"choices": ["One", "one "]}, "choices_not_distinct"), ({"answer": "A"}, "answer_key"),
    ]
    cited = [(n, "good", "some  WORDS") for n in range(len(wrong))]
    extra = {"none": [], "many": [("good", "words")] * 9, "false": [("good", "other words")], "gone": [("nowhere", "words")], "far": [("far", "words")], "old": [("good", "some"), ("old", "words")]}
    numbered = dict(enumerate(extra, 100))
    cited += [(n, *c) for n, name in numbered.items() for c in extra[name]]
    rows = [asked(n, **own) for n, (own, _) in enumerate(wrong)] + [asked(n) for n in numbered]
    got = {r.question: r.error for r in found(spark, rows, cited).collect()}
    assert [got[n] for n in range(len(wrong))] == [e for _, e in wrong]
    assert [got[n] for n in numbered] == ["citations", "citations", "evidence", "evidence", "outside_scope", "outdated_source"]


def test_saved_batches(spark):
    rows = [asked(1, batch=1), asked(2, batch=1, prompt="r?"), asked(3, batch=1), asked(4, batch=2, prompt="s?"), asked(5, batch=2, topic=""), asked(6, batch=3, prompt="s?"), asked(7, batch=3, prompt="old?"), asked(8, batch=4, prompt="u?")]
    valid = found(spark, rows, [(r[0], "good", "words") for r in rows]).withColumn("key", F.col("prompt")).withColumn("size", F.lit(10))
    known = spark.createDataFrame([("p", "old?"), ("q", "q?")], "plan string, key string")
    states = lambda **how: {r.question: r.state for r in questions.saved(valid, known, **how).collect()}
    want = {1: "added", 2: "added", 3: "duplicate", 4: "batch_refused", 5: "topic", 6: "added", 7: "duplicate", 8: "added"}
    assert states() == want
    assert states(plan_most=4) == want | {8: "plan_full"}
    assert states(most=2) == want | {1: "batch_too_large", 2: "batch_too_large", 3: "batch_too_large"}
    assert questions.saved(valid.limit(0), known).count() == 0


def test_outline_slice(spark):
    text = "# Course\n\nintro\n## Module 1: A\nx\n### sub\n## Module 02: B\ny\n\n## Other\nz"
    rows = spark.createDataFrame([(text,), ("## Module 2: only",), (None,), ("## Module 20: no",)], "t string")
    assert [r[0] for r in rows.select(outline_slice(F.col("t"), 2)).collect()] == ["# Course\n\nintro\n## Module 02: B\ny\n", "## Module 2: only\n", "", ""]
    assert rows.select(outline_slice(F.col("t"), 1)).first()[0] == "# Course\n\nintro\n## Module 1: A\nx\n### sub\n"
