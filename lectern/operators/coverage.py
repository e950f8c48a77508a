"""Expected units against present ones: missing units, runs of them, and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_units(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), list(keys), "left_anti")


def islands(units: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of following numbers: ``keys..., first, last``."""
    run = F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number))
    return units.distinct().withColumn("__run", run).groupBy(*keys, "__run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("__run")


def gaps(present: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of numbers from 1 to a key's largest that no row has: ``keys..., first, last``, found
    between a row and the one before it.  Repeated rows, and numbers that are null or below 1, do not matter."""
    before = F.lag(number).over(W.partitionBy(*keys).orderBy(number))
    found = present.select(*keys, number).where(F.col(number) >= 1).withColumn("first", F.coalesce(before, F.lit(0)) + 1)
    return found.where(F.col("first") < F.col(number)).select(*keys, "first", (F.col(number) - 1).alias("last"))


def worded(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., units`` such as ``1-3, 5``."""
    label = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    parts = F.sort_array(F.collect_list(F.struct("first", label.alias("label"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["label"]), ", ").alias("units"))


def progress(items: DataFrame, levels: Sequence[str], done: str) -> DataFrame:
    """Totals, done and completeness at every level of a hierarchy and for all."""
    return items.rollup(*levels).agg(
        F.count("*").alias("total"), F.count_if(done).alias("done"), F.bool_and(done).alias("complete")
    )


def gap_groups(rows: DataFrame, keys: Sequence[str], at: str, gap: float) -> DataFrame:
    """``rows`` with ``group``: a new one where a row is more than ``gap`` after the last."""
    order = W.partitionBy(*keys).orderBy(at)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(0))
    return rows.withColumn("__new", fresh).withColumn("group", F.sum("__new").over(order)).drop("__new")


def distinct_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def frequent_lines(lines: DataFrame, document: str, line: str, units: str, least: int, share: float) -> DataFrame:
    """Lines that stand in at least ``least`` units of a document and ``share`` of them."""
    per = lines.groupBy(document, line).agg(F.countDistinct(units).alias("times"))
    sizes = lines.groupBy(document).agg(F.countDistinct(units).alias("of"))
    return per.join(sizes, document).where((F.col("times") >= least) & (F.col("times") >= share * F.col("of")))
