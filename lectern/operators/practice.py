"""Practice analytics: accuracy, the spaced review schedule, queues and evidence checks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from lectern.operators.folds import folded

# Days until the next review after so many good answers in a row.
GOOD_DAYS = (1, 3, 7, 14, 30)
AGAIN_MINUTES, HARD_DAYS = 10, 1
RECENT = 20


def accuracy(attempts: DataFrame, question: str, order: str, correct: str) -> DataFrame:
    """First, latest and recent accuracy per question; recent is of the last ``RECENT``."""
    newest = F.row_number().over(W.partitionBy(question).orderBy(F.desc(order)))
    value = F.col(correct).cast("double")
    return attempts.withColumn("__n", newest).groupBy(question).agg(
        F.min_by(value, order).alias("first"),
        F.max_by(value, order).alias("latest"),
        F.round(F.avg(F.when(F.col("__n") <= RECENT, value)), 3).alias("recent"),
        F.count("*").alias("attempts"),
    )


def next_state(streak: int, due: int | None, at: int, rating: str) -> tuple[int, int]:
    """``(streak, due)`` after an attempt; times are seconds.  A good answer before the question
    is due again keeps the streak."""
    if rating == "good":
        streak = streak + 1 if due is None or at >= due else max(1, streak)
        return streak, at + GOOD_DAYS[min(streak, len(GOOD_DAYS)) - 1] * 86400
    return 0, at + (HARD_DAYS * 86400 if rating == "hard" else AGAIN_MINUTES * 60)


def review_schedule(attempts: DataFrame, question: str, at: str, rating: str) -> DataFrame:
    """``(question, streak, due)`` after all attempts in order of time.

    ``at`` is in whole seconds.  Ratings are good, hard and again; others count as again, and
    attempts at the same second are taken in order of rating.  Attempts without a time are none.
    """

    def last_state(own: Iterator[dict]) -> Iterator[dict]:
        streak, due = 0, None
        for row in own:
            streak, due = next_state(streak, due, row["at"], row["rating"])
        yield {"streak": streak, "due": due}

    rows = attempts.where(F.col(at).isNotNull()).select(question, F.col(at).cast("long").alias("at"), F.col(rating).alias("rating"))
    schema = StructType([rows.schema[question], StructField("streak", IntegerType()), StructField("due", LongType())])
    return folded(rows, question, ["at", "rating"], schema, last_state)


def attempt_history(steps: DataFrame, question: str, at: str, order: str, kind: str, choice: str) -> DataFrame:
    """Each attempt as ``(question, order, streak, due, assisted)``: the schedule after it, and
    whether its answer was seen before it.

    ``kind`` is good, hard, again or reveal.  Revealing the answer of a multiple-choice question
    (``choice``) after an attempt reviews that attempt, once; any other reveal makes the next
    attempt assisted.  An attempt clears the mark.  Steps are taken in order of ``at`` (whole
    seconds), then ``order``; those without a time or kind are none, a null ``choice`` is false.
    """

    def history(own: Iterator[dict]) -> Iterator[dict]:
        streak, due, seen, unreviewed = 0, None, False, False
        for row in own:
            if row["kind"] != "reveal":
                streak, due = next_state(streak, due, row["at"], row["kind"])
                yield {order: row[order], "streak": streak, "due": due, "assisted": seen}
                seen, unreviewed = False, True
            elif row["choice"] and unreviewed:
                unreviewed = False
            else:
                seen = True

    named = steps.where(F.col(at).isNotNull() & F.col(kind).isNotNull())
    rows = named.select(question, order, F.col(at).cast("long").alias("at"), F.col(kind).alias("kind"), F.col(choice).alias("choice"))
    found = [StructField("streak", IntegerType()), StructField("due", LongType()), StructField("assisted", BooleanType())]
    return folded(rows, question, ["at", order], StructType([rows.schema[question], rows.schema[order], *found]), history)


def review_queue(schedule: DataFrame, now: int, weak: Column) -> DataFrame:
    """``schedule`` with ``priority``: 0 due, 1 weak, 2 new, 3 scheduled."""
    priority = F.when(F.col("due") <= now, 0).when(weak, 1).when(F.col("due").isNull(), 2).otherwise(3)
    return schedule.withColumn("priority", priority.cast("int"))


def dedup_key(*columns: str) -> Column:
    """A digest of a question's content, with its fields in a fixed order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def answer_key_problem(answer: Column, choices: Column, correct: Column) -> Column:
    """Null if the worded answer goes with the marked choice, else what is wrong.

    A single letter names a choice; other answers are compared by their words with each
    choice, and a choice that is clearly nearer than the marked one is a problem.
    """
    fold = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), r"\b(the|an|a)\b ?", ""))
    letter = F.regexp_extract(answer, r"(?i)^(?:the answer is |answer:? )?\(?([a-h])\)?\.?$", 1)
    named = F.ascii(F.upper(letter)) - F.ascii(F.lit("A"))
    words = F.split(fold(answer), " ")

    def overlap(choice: Column) -> Column:
        own = F.array_distinct(F.split(fold(choice), " "))
        return F.size(F.array_intersect(own, words)) / F.greatest(F.size(own), F.lit(1))

    scores = F.transform(choices, overlap)
    mine = F.get(scores, correct)
    rival = F.array_max(F.filter(scores, lambda s, i: i != correct))
    return (
        F.when((correct < 0) | (correct >= F.size(choices)), "no such choice")
        .when((letter != "") & (named != correct), "names another choice")
        .when((letter == "") & (rival >= 0.6) & (rival - mine >= 0.3), "words of another choice")
    )


def first_failure(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that fails, in order; null if none does."""
    out = None
    for failed, code in checks:
        out = F.when(failed, code) if out is None else out.when(failed, code)
    return out


def validate_quotes(citations: DataFrame, sources: DataFrame, quote: str, text: str, key: str) -> DataFrame:
    """``citations`` with ``error``: null where the folded quote is in its source's text."""
    from lectern.functions.text import evidence_size, quote_fold

    joined = citations.join(sources.select(key, quote_fold(F.col(text)).alias("__text")), key, "left")
    folded = quote_fold(F.col(quote))
    error = first_failure(
        (F.col("__text").isNull(), "missing_source"),
        (F.coalesce(evidence_size(folded), F.lit(0)) < 2, "invalid_citation"),
        (~F.contains("__text", folded), "quote_mismatch"),
    )
    return joined.withColumn("error", error).drop("__text")
