"""Close names against all pairs, nested threads against a plain walk, reviewed sources and carried notes by example."""

import json
import random

from lectern.operators import changes, locators, threads, upkeep


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, was = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


def test_close_names_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abå ") for _ in range(rng.randint(1, 14))).strip() or "b"
    cited = {(rng.choice("pq"), word()) for _ in range(120)}
    named = {(rng.choice("pq"), word()) for _ in range(160)}
    make = lambda rows: spark.createDataFrame([*rows, ("p", None), (None, "ab"), ("p", "")], "path string, locator string")
    for least in (0.6, 0.75, 1.0):
        want = set()
        squeezed = lambda rows: {(p, " ".join(w.split())) for p, w in rows}
        for path, one in squeezed(cited):
            near = [(edits(one, n) / max(len(one), len(n)), n) for p, n in squeezed(named) if p == path]
            near = sorted((d, n) for d, n in near if 1 - d >= least - 1e-9)[:4]
            want |= {(path, one, r, n) for r, (_, n) in enumerate(near, 1)}
        got = locators.close_names(make(cited), make(named), least, most=4).collect()
        assert {(r.path, r.locator, r.rank, r.name) for r in got} == want
    assert locators.close_names(make(cited).limit(0), make(named)).count() == 0


def test_threads(spark):
    reply = lambda i, *answers, **more: {"id": i, "user_id": i % 2, "message": f"m{i}", "replies": list(answers), **more}
    view = {
        "view": [reply(1, reply(2, reply(3)), reply(4)), "odd", reply(5, deleted=True, replies=None)],
        "participants": [{"id": 0, "display_name": "Ann"}], "new_entries": [reply(3), reply(6)],
    }
    deep = '{"view":' + '[{"id":1,"replies":' * 200 + "[]" + "}]" * 200 + "}"
    bodies = [("a", json.dumps(view)), ("b", None), ("c", " "), ("d", "{"), ("e", "[1]"), ("f", deep), ("g", "{}")]
    table = spark.createDataFrame(bodies, "k string, body string")
    rows = threads.replies(table, "k", "body")
    found = [r for r in rows.orderBy("k", "position").collect()]
    assert [(r.id, r.depth, r.path, r.parent, r.author) for r in found if r.k == "a"] == [
        ("1", 0, [0], None, None), ("2", 1, [0, 0], "1", "Ann"), ("3", 2, [0, 0, 0], "2", None), ("4", 1, [0, 1], "1", "Ann"),
        ("5", 0, [1], None, None), ("6", 0, [2], None, "Ann"),
    ]
    assert [r.depth for r in found if r.k == "f"] == list(range(200))
    assert [(r.k, r.error) for r in found if r.error] == [("d", "unreadable"), ("e", "unreadable")]
    text = {r.k: r.markdown for r in threads.render(table.select("k"), rows, "k", spark.createDataFrame([("1",)], "author_id string")).collect()}
    assert text["a"].split("\n") == [
        "- **Someone (Instructor)**: m1", "  - **Ann**: m2", "    - **Someone (Instructor)**: m3", "  - **Ann**: m4", "- _(deleted reply)_", "- **Ann**: m6",
    ]
    assert text["b"] == text["c"] == text["g"] == threads.NO_REPLIES and text["d"] == text["e"] == threads.UNREADABLE


def test_lines_of_a_reply(spark):
    view = {"view": [{"id": 1, "message": "x", "replies": [{"id": 2, "message": " one  \n\n two\n", "created_at": "2024-05-06T07:08:09Z"}]}, {"id": 3}]}
    table = spark.createDataFrame([(1, json.dumps(view))], "k int, body string")
    text = threads.render(table.select("k"), threads.replies(table, "k", "body"), "k").first().markdown
    assert text.split("\n") == ["- **Someone**: x", "  - **Someone** · 2024-05-06:", "    one", "", "     two", "- **Someone**:"]


def test_scope_diff(spark):
    was = spark.createDataFrame([("a", "1", None), ("b", "old", False), ("c", "x", False), ("d", None, False), ("e", "1", True), ("f", "1", False)], "k string, s string, m boolean")
    now = spark.createDataFrame([("a", "1", None, False), ("b", "new", "old", None), ("c", "y", "z", False), ("d", "q", None, False), ("e", "1", None, False), ("g", "1", None, False), (None, "1", None, None)], "k string, s string, l string, m boolean")
    found = changes.scope_diff(was, now.withColumnRenamed("l", "legacy"), "k", "s", "legacy", "m")
    assert {r.k: r.change for r in found.collect()} == {
        "a": "unchanged", "b": "unchanged", "c": "changed", "d": "unchanged", "e": "changed", "f": "removed", "g": "added",
    }


def test_carried_over(spark):
    day = lambda n: f"2024-01-{n:02}"
    saved = spark.createDataFrame(
        [("a", "A", 1, day(5), "n1"), ("b", None, 2, day(5), "n2"), ("c", None, 2, day(5), "n3"), ("d", None, 9, day(5), "n4"),
         ("x", "C", 1, day(5), "n5"), ("y", "Q", 1, day(5), "n6"), ("z", None, 1, day(5), "n7"), ("e", None, 3, day(5), "n8"), (None, "A", 1, day(5), "n9")],
        "path string, digest string, size int, day string, note string",
    )
    files = spark.createDataFrame(
        [("a", "A", 1, day(9)), ("b", "B", 2, day(4)), ("c", "C", 2, day(5)), ("d", "D", 2, day(1)), ("cc", "C", 2, day(1)), ("e", "E", 3, None)],
        "path string, digest string, size int, touched string",
    )
    found = upkeep.carried_over(saved, files, "path", "digest", "size", "day", "touched")
    assert {r.note: (r.path, r.digest, r.state) for r in found.collect()} == {
        "n1": ("a", "A", "current"), "n2": ("b", "B", "carried"), "n3": ("c", None, "stale"), "n4": ("d", None, "stale"), "n5": ("c", "C", "moved"),
        "n6": ("y", "Q", "gone"), "n7": ("z", None, "gone"), "n8": ("e", None, "stale"), "n9": ("a", "A", "moved"),
    }
