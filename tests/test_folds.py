"""Folds that hold a state and no key's rows, and the rule of attempts whose answer was seen."""

from lectern.operators import folds, practice


def test_a_key_of_many_batches(spark):
    rows = spark.range(60_000).selectExpr("cast(null as string) as k", "id as at", "cast(id as double) as v")
    found = folds.key_frames(rows, "k", "at", "v", change=9.0, gap=5, most=10_000).collect()
    assert sorted(r.at for r in found) == list(range(0, 60_000, 10)) and {r.k for r in found} == {None}
    spread = spark.range(30_000).selectExpr("id % 7 as k", "id as i", "concat('text ', id) as t")
    assert folds.collapse_captions(spread, "k", "i", "t").count() == 30_000


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", None, 1.0), ("a", 1, None), ("a", 2, 3.0)], "k string, at long, v double")
    assert [tuple(r) for r in folds.key_frames(rows, "k", "at", "v", 1.0, 0).collect()] == [("a", 2, 3.0)]
    assert folds.key_frames(rows.limit(0), "k", "at", "v", 1.0, 0).count() == 0
    nothing = spark.createDataFrame([("a", None, "good")], "q string, at long, rating string")
    assert practice.review_schedule(nothing, "q", "at", "rating").count() == 0


def test_seen_answers(spark):
    def assisted(choice, *kinds):
        rows = [("q", n, n, kind, choice) for n, kind in enumerate(kinds)]
        steps = spark.createDataFrame(rows, "q string, n long, at long, kind string, choice boolean")
        return [r.assisted for r in practice.attempt_history(steps, "q", "at", "n", "kind", "choice").orderBy("n").collect()]

    assert assisted(False, "reveal", "good", "again") == [True, False]
    assert assisted(False, "good", "reveal", "good") == [False, True]
    assert assisted(True, "good", "reveal", "good") == [False, False]  # reviewed after the attempt
    assert assisted(True, "good", "reveal", "reveal", "good") == [False, True]  # a second look is before the next
    assert assisted(None, "reveal", "hard", "hard") == [True, False]
