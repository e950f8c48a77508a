"""Change capture between snapshots, retirement, unique paths and moved keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stamp(*columns: str) -> Column:
    """A digest of columns for rows that carry no modification time."""
    return F.sha1(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """``(key, change)``: insert, delete, update or unchanged, by key and stamp."""
    before, after = old.select(key, F.col(stamp).alias("before")), new.select(key, F.col(stamp).alias("after"))
    both = before.withColumn("was", F.lit(True)).join(after.withColumn("now", F.lit(True)), key, "full_outer")
    change = (
        F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete")
        .when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("update")
    )
    return both.select(key, change.alias("change"))


def scope_diff(reviewed: DataFrame, current: DataFrame, key: str, stamp: str, legacy: str, missing: str) -> DataFrame:
    """``(key, change)``: added, removed, changed or unchanged since the sources were reviewed.

    A source is unchanged if its reviewed ``stamp`` is the current one in either of two forms
    (``stamp`` or ``legacy``; a null stamp is equal to a null one) and it is ``missing`` now as it was
    then; a null ``missing`` is false.  Both tables have one row a key; null keys are left out.
    """
    flag = F.coalesce(F.col(missing), F.lit(False))
    before = reviewed.where(F.col(key).isNotNull()).select(key, F.col(stamp).alias("__was"), flag.alias("__was_missing"), F.lit(True).alias("__reviewed"))
    after = current.where(F.col(key).isNotNull()).select(key, F.col(stamp).alias("__now"), F.col(legacy).alias("__legacy"), flag.alias("__missing"), F.lit(True).alias("__current"))
    same = F.col("__was").eqNullSafe(F.col("__now")) | F.col("__was").eqNullSafe(F.col("__legacy"))
    change = (
        F.when(F.col("__reviewed").isNull(), "added").when(F.col("__current").isNull(), "removed")
        .when(same & (F.col("__was_missing") == F.col("__missing")), "unchanged").otherwise("changed")
    )
    return before.join(after, key, "full_outer").select(key, change.alias("change"))


def mark_and_sweep(items: DataFrame, seen: DataFrame, listings: DataFrame, key: str, kind: str) -> DataFrame:
    """``items`` with ``state``: seen; removed if unseen and every listing of its kind was
    complete; kept if a listing failed; restored if seen after it was removed."""
    whole = listings.groupBy(kind).agg(F.bool_and("complete").alias("whole"))
    joined = items.join(seen.select(key).distinct().withColumn("found", F.lit(True)), key, "left").join(whole, kind, "left")
    state = (
        F.when(F.col("found") & F.col("removed"), "restored").when(F.col("found"), "seen")
        .when(F.col("removed"), "removed").when(F.coalesce("whole", F.lit(False)), "removed").otherwise("kept")
    )
    return joined.withColumn("state", state).drop("found", "whole")


def claim_paths(items: DataFrame, key: str, path: str, owned: Column | None = None) -> DataFrame:
    """``(key, path, claimed)``: paths are unique whatever their case; owners keep theirs,
    then the least key; the others get their key before the extension."""
    first = F.coalesce(owned, F.lit(False)) if owned is not None else F.lit(False)
    nth = F.row_number().over(W.partitionBy(F.lower(path)).orderBy(F.desc(first), key))
    dot = F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,8})$", 1)
    stem = F.expr(f"substring({path}, 1, length({path}) - length(__dot))")
    with_dot = items.withColumns({"__nth": nth, "__dot": dot})
    other = F.concat(stem, F.lit(" ("), F.col(key).cast("string"), F.lit(")"), F.col("__dot"))
    return with_dot.select(key, path, F.when(F.col("__nth") == 1, F.col(path)).otherwise(other).alias("claimed"))


def move_keys(items: DataFrame, moves: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """``items`` with ``moved``: the path after the longest matching ``(old, new)`` prefix
    of whole segments.  Prefixes are exploded, so it is an equi-join."""
    parts = F.split(path, separator, -1)
    sizes = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    prefixes = F.transform(sizes, lambda n: F.struct(n.alias("n"), F.concat_ws(separator, F.slice(parts, 1, n)).alias("old")))
    keyed = items.withColumn("__id", F.monotonically_increasing_id())
    hits = keyed.select("__id", F.explode(prefixes).alias("p")).select("__id", "p.n", "p.old").join(moves, "old")
    best = hits.groupBy("__id").agg(F.max_by(F.struct("old", "new"), "n").alias("move"))
    moved = F.concat(F.col("move.new"), F.expr(f"substring({path}, length(move.old) + 1)"))
    return keyed.join(best, "__id", "left").withColumn("moved", F.coalesce(moved, F.col(path))).drop("__id", "move")


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def keep_last_good(old: DataFrame, new: DataFrame, listings: DataFrame, kind: str) -> DataFrame:
    """The new rows of kinds whose listing was complete, and the old rows of the others."""
    whole = listings.groupBy(kind).agg(F.bool_and("complete").alias("whole")).where("whole").select(kind)
    return new.join(whole, kind, "left_semi").unionByName(old.join(whole, kind, "left_anti"))


def last_state(rows: DataFrame, key: str, at: str, ok: str) -> DataFrame:
    """``(key, state, last_good)``: current after a success, stale after a failure that
    follows one, failed where nothing ever succeeded."""
    good = F.max(F.when(F.col(ok), F.col(at)))
    found = rows.groupBy(key).agg(good.alias("last_good"), F.max(at).alias("last"))
    state = F.when(F.col("last_good").isNull(), "failed").when(F.col("last_good") < F.col("last"), "stale").otherwise("current")
    return found.select(key, state.alias("state"), "last_good")
