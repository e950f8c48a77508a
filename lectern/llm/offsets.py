"""Running totals over a whole table in a given order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.storage import materialize


def running_offsets(df: DataFrame, order: list[str], weight: str | dict[str, str], out: str = "") -> DataFrame:
    """``df`` with long ``out``: the sum of ``weight`` over all rows before this one.  For
    several sums at once, ``weight`` maps the columns to add to their results.

    ``order`` must be a total order.  The table is range-partitioned and written with its
    partition numbers; sums run within partitions, and one total per partition (their
    number is a setting, not a property of the data) gives each its base.
    """
    sums = weight if isinstance(weight, dict) else {weight: out}
    parted = materialize(
        df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges"
    )
    before = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = parted.groupBy("__part").agg(*(F.sum(c).alias(f"__total_{o}") for c, o in sums.items()))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("__part", *(F.coalesce(F.sum(f"__total_{o}").over(earlier), F.lit(0)).alias(f"__base_{o}") for o in sums.values()))
    local = parted.withColumns({f"__local_{o}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c, o in sums.items()})
    joined = local.join(F.broadcast(bases), "__part").withColumns({o: F.expr(f"cast(__local_{o} + __base_{o} as long)") for o in sums.values()})
    return joined.drop("__part", *(f"__{k}_{o}" for k in ("local", "base") for o in sums.values()))
