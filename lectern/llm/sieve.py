"""A bitmap of fixed size that tells which rows cannot be in a key set.

The set may be of any size; its bitmap is ``bits / 8`` bytes, so that broadcasting it has
a proven bound.  A row whose bit is clear is not in the set; a row whose bit is set may
be, and goes on to an exact step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 22  # 65,536 words of 64 bits: 1 MB as rows


def build(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """``(sieve_word int, sieve_mask long)``, at most ``bits / 64`` rows."""
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    return (
        keys.select(slot.alias("s"))
        .groupBy(F.expr("cast(shiftright(s, 6) as int)").alias("sieve_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("sieve_mask"))
    )


def mark(rows: DataFrame, sieve: DataFrame, key: Column, out: str, bits: int = BITS) -> DataFrame:
    """``rows`` with boolean ``out``: false only if the key is surely not in the set."""
    return (
        rows.withColumn("__slot", F.pmod(F.xxhash64(key), F.lit(bits)))
        .withColumn("sieve_word", F.expr("cast(shiftright(__slot, 6) as int)"))
        .join(F.broadcast(sieve), "sieve_word", "left")
        .withColumn(out, F.expr("coalesce((shiftright(sieve_mask, cast(__slot & 63 as int)) & 1L) = 1L, false)"))
        .drop("__slot", "sieve_word", "sieve_mask")
    )


def without(rows: DataFrame, losers: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``rows`` whose keys are not in ``losers``; wide rows that the sieve clears
    are not shuffled.  ``keys`` maps the columns of ``losers`` to expressions over ``rows``.
    Nulls are equal.  Rows are carried as one struct, so their names cannot clash."""
    names = {k: f"key_{i}" for i, k in enumerate(keys)}
    losers = losers.select(*(F.col(k).alias(names[k]) for k in keys)).distinct()
    sieve = build(losers, F.struct(*names.values()))
    wrapped = rows.select(F.struct("*").alias("whole"), *(c.alias(names[k]) for k, c in keys.items()))
    marked = mark(wrapped, sieve, F.struct(*names.values()), "maybe")
    left, right = marked.where("maybe").alias("l"), losers.alias("r")
    same = F.lit(True)
    for n in names.values():
        same &= F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    kept = left.join(right, same, "left_anti").select("whole")
    return marked.where("not maybe").select("whole").unionByName(kept).select("whole.*")
