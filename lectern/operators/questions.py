"""Questions of a practice plan: what is wrong with one, and which of a batch are saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import practice, upkeep

# Kinds, difficulties, and the most characters of each field.
KINDS, DIFFICULTIES = ("mcq", "short_answer"), ("recall", "application", "transfer")
LENGTHS = {"topic": 200, "prompt": 6000, "answer": 12000, "explanation": 12000}
MOST_CHOICE, FEWEST_CHOICES, MOST_CHOICES, MOST_CITATIONS, MOST_OF_PLAN = 2000, 2, 8, 8, 500
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"  # fixed value: signs that no field may hold


def _bad(text: Column, most: int) -> Column:
    own = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.coalesce((own == "") | (F.length(own) > most) | own.rlike(CONTROL), F.lit(True))


def form_problem() -> Column:
    """The first thing wrong with a question's own fields (``kind, topic, prompt, answer,
    explanation, difficulty, choices, correct``); null if nothing is."""
    many = F.coalesce(F.size("choices"), F.lit(0))
    choice = F.col("kind") == "mcq"
    folded = F.transform("choices", lambda c: F.lower(F.trim(c)))
    return practice.first_failure(
        (~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind"),
        *((_bad(F.col(name), most), name) for name, most in LENGTHS.items()),
        (~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)), "difficulty"),
        (choice & ~F.coalesce(many.between(FEWEST_CHOICES, MOST_CHOICES) & (F.col("correct") >= 0) & (F.col("correct") < many), F.lit(False)), "choices"),
        (choice & F.exists("choices", lambda c: _bad(c, MOST_CHOICE)), "choice"),
        (choice & (F.size(F.array_distinct(folded)) < many), "choices_not_distinct"),
        (choice & practice.answer_key_problem(F.col("answer"), F.col("choices"), F.col("correct")).isNotNull(), "answer_key"),
    )


def validated(questions: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """``questions`` (by ``question``) with ``error``, null for those that may be saved.

    ``citations`` are ``(question, path, quote)``, ``sources`` the ``(path, text, in_scope,
    current)`` that may be cited.  After a question's own fields come the number of its
    citations, quotes that are not in their source, sources outside the plan, and sources
    that have gone out of date.  A question is read once and each citation joins its source
    by path; nothing is gathered but counts.
    """
    checked = practice.validate_quotes(citations, sources, "quote", "text", "path")
    known = checked.join(sources.select("path", "in_scope", "current"), "path", "left")
    counts = known.groupBy("question").agg(
        F.count("*").alias("__cited"), F.count("error").alias("__unproven"),
        F.count_if(~F.coalesce("in_scope", F.lit(False))).alias("__outside"), F.count_if(~F.coalesce("current", F.lit(False))).alias("__old"),
    )
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    evidence = practice.first_failure(
        (~F.coalesce(F.col("__cited").between(1, MOST_CITATIONS), F.lit(False)), "citations"),
        (some("__unproven"), "evidence"), (some("__outside"), "outside_scope"), (some("__old"), "outdated_source"),
    )
    return questions.join(counts, "question", "left").withColumn("error", F.coalesce(form_problem(), evidence)).drop("__cited", "__unproven", "__outside", "__old")


def saved(questions: DataFrame, known: DataFrame, batch: str = "batch", most: int = upkeep.MOST_QUESTIONS, plan_most: int = MOST_OF_PLAN) -> DataFrame:
    """``questions`` (validated, with ``batch, plan, key, size``) with ``state``: ``added``,
    ``duplicate`` (the plan has its ``key``, or an earlier one of the batch has), or why not.

    A batch with a bad question, too many questions or bytes is refused whole.  So is one
    that would fill its plan beyond ``plan_most``, and those of the plan after it: batches
    are taken in their order.  ``known`` are the plan's ``(plan, key)`` so far.
    """
    gated = upkeep.gate_batches(questions, batch, F.col("error"), F.col("size"), most=most).withColumnRenamed("error", "refused")
    held = known.select("plan", "key").distinct()
    first = F.row_number().over(W.partitionBy("plan", "key").orderBy(F.col("refused").isNotNull(), batch, "question"))
    rows = gated.join(held.withColumn("__held", F.lit(True)), ["plan", "key"], "left").withColumn("__first", first)
    fresh = F.col("__held").isNull() & (F.col("__first") == 1) & F.col("refused").isNull()
    new = rows.groupBy("plan", batch).agg(F.count_if(fresh).alias("__new"))
    grown = F.sum("__new").over(W.partitionBy("plan").orderBy(batch)) + F.coalesce("__had", F.lit(0))
    full = new.join(held.groupBy("plan").agg(F.count("*").alias("__had")), "plan", "left").select("plan", batch, (grown > plan_most).alias("__full"))
    state = F.coalesce("refused", F.when(F.col("__full"), "plan_full"), F.when(fresh, "added").otherwise("duplicate"))
    return rows.join(full, ["plan", batch], "left").withColumn("state", state).drop("__held", "__first", "__full", "refused")
