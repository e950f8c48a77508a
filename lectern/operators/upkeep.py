"""Keeping plans, descriptions and counts: batch gates, reveals, cascades, re-stamping, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.storage import materialize

MOST_QUESTIONS, MOST_BYTES = 50, 1 << 20  # of a batch
LEAST_DESCRIPTION, MOST_DESCRIPTION = 20, 2500  # characters


def gate_batches(rows: DataFrame, batch: str, problem: Column, size: Column, most: int = MOST_QUESTIONS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` with ``error``: a batch is saved whole or not at all.  A row's own ``problem``
    comes first, then that its batch is too large, then that another row has a problem."""
    known = rows.withColumn("__problem", problem).withColumn("__size", size)
    whole = known.groupBy(batch).agg(F.count("*").alias("__n"), F.sum("__size").alias("__bytes"), F.count("__problem").alias("__bad"))
    joined = known.join(whole, batch)
    error = F.coalesce(
        "__problem",
        F.when((F.col("__n") > most) | (F.col("__bytes") > most_bytes), "batch_too_large"),
        F.when(F.col("__bad") > 0, "batch_refused"),
    )
    return joined.withColumn("error", error).drop("__problem", "__size", "__n", "__bytes", "__bad")


def assisted(events: DataFrame, keys: Sequence[str], order: Sequence[str], revealed: Column) -> DataFrame:
    """The attempts among ``events``, with ``assisted``: whether the answer was revealed since
    the attempt before.  Events that are not reveals are attempts, and each clears the mark."""
    ordered = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    marked = events.withColumn("__revealed", F.coalesce(revealed, F.lit(False)))
    last = F.last("__revealed").over(ordered)
    return marked.withColumn("assisted", F.coalesce(last, F.lit(False))).where("not __revealed").drop("__revealed")


def without_plans(gone: DataFrame, plan: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Each of ``tables`` (plans, questions, attempts) without the rows of the plans in ``gone``."""
    names = gone.select(plan).distinct()
    return tuple(t.join(names, plan, "left_anti") for t in tables)


def restamped(saved: DataFrame, sources: DataFrame, key: str, before: Column, now: Column) -> DataFrame:
    """``saved`` (``key, stamp``) with stamps of an older kind replaced where they still hold:
    ``before`` and ``now`` are a source's stamp of the old and the new kind.  ``state`` is
    current, upgraded, changed or missing."""
    known = sources.select(key, before.alias("__before"), now.alias("__now"))
    joined = saved.join(known, key, "left")
    state = (
        F.when(F.col("__now").isNull(), "missing").when(F.col("stamp") == F.col("__now"), "current")
        .when(F.col("stamp") == F.col("__before"), "upgraded").otherwise("changed")
    )
    joined = joined.withColumn("state", state)
    return joined.withColumn("stamp", F.when(F.col("state") == "upgraded", F.col("__now")).otherwise(F.col("stamp"))).drop("__before", "__now")


def save_descriptions(saved: DataFrame, written: DataFrame, key: str, text: str, at: str) -> DataFrame:
    """``saved`` and ``written`` as one table: of each key the newest usable description.  Those
    of fewer than ``LEAST_DESCRIPTION`` or more than ``MOST_DESCRIPTION`` characters are not."""
    usable = written.where(F.length(F.trim(text)).between(LEAST_DESCRIPTION, MOST_DESCRIPTION))
    both = saved.select(key, text, at, F.lit(0).alias("__new")).unionByName(usable.select(key, F.trim(text).alias(text), at, F.lit(1).alias("__new")))
    best = F.max(F.struct(at, "__new", text))
    return both.groupBy(key).agg(best.alias("b")).select(key, f"b.{text}", f"b.{at}")


def run_statistics(events: DataFrame, course: str, metrics: dict[str, Column]) -> DataFrame:
    """``(course, metric, value)``: what a run has counted, by course and over all (null course)."""
    sums = [F.sum(c).alias(n) for n, c in metrics.items()]
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in metrics))
    found = events.rollup(course).agg(*sums, F.grouping(course).alias("__all"))
    return found.select(F.when(F.col("__all") == 0, F.col(course)).alias(course), "__all", F.explode(pairs).alias("m")).select(
        course, (F.col("__all") == 1).alias("overall"), "m.metric", "m.value"
    )


def reached(edges: DataFrame, start: DataFrame, node: str = "node") -> DataFrame:
    """``(node, round)`` of all that ``edges`` (``a, b``) lead to from ``start``, each with its
    first round: rounds go on until one finds nothing new."""
    known = materialize(start.select(node).distinct().withColumn("round", F.lit(0)), "reached")
    newest, n = known, 0
    while not newest.isEmpty():
        n += 1
        found = edges.join(newest.select(F.col(node).alias("a")), "a").select(F.col("b").alias(node)).distinct()
        newest = materialize(found.join(known, node, "left_anti").withColumn("round", F.lit(n)), "newest")
        known = known.unionByName(newest)
    return known


def carried_over(saved: DataFrame, files: DataFrame, key: str, digest: str, size: str, described: str, touched: str) -> DataFrame:
    """``saved`` descriptions with their ``key`` and ``digest`` brought up to date, and ``state``.

    ``files`` has one row a key.  A description is current if its digest is the file's; one without
    a digest is carried over, and takes the file's, if the file has the size that was described and
    was last touched on an earlier day; else it is stale.  One whose file is gone moves to the file
    with its digest (the least key of several), or is gone too.  Nulls in size or time prove nothing.
    Copies of a file are reduced to their least key before they are joined.
    """
    own = files.select(F.col(key), F.col(digest).alias("__digest"), F.col(size).alias("__size"), F.col(touched).alias("__touched"), F.lit(True).alias("__here"))
    places = files.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias(digest)).agg(F.min(key).alias("__place"))
    unproven = F.col(digest).isNull() & (F.col(size) == F.col("__size")) & (F.col("__touched") < F.col(described))
    state = (
        F.when(F.col("__here") & (F.col(digest) == F.col("__digest")), "current").when(F.col("__here") & unproven, "carried")
        .when(F.col("__here"), "stale").when(F.col("__place").isNotNull(), "moved").otherwise("gone")
    )
    joined = saved.join(own, key, "left").join(places, digest, "left").withColumn("state", state)
    fresh = {
        key: F.when(F.col("state") == "moved", F.col("__place")).otherwise(F.col(key)),
        digest: F.when(F.col("state") == "carried", F.col("__digest")).otherwise(F.col(digest)),
    }
    return joined.withColumns(fresh).select(*saved.columns, "state")
