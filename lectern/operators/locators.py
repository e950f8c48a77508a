"""What a locator that opens no section may have meant: names near to it in its own source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import norm_locator
from lectern.storage import materialize

EDGE = 1e-9  # keeps a bound that is a whole number whole


def _letter_pairs(name: Column) -> Column:
    """Pairs of adjacent characters of a name with its two ends marked, equal ones numbered."""
    marked = F.concat(F.lit("\u0001"), name, F.lit("\u0002"))
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substr(marked, i, F.lit(2))))
    return F.transform(pairs, lambda p, i: F.struct(p.alias("pair"), (i - F.array_position(pairs, p)).alias("nth")))


def close_names(citations: DataFrame, sections: DataFrame, least: float = 0.6, most: int = 3) -> DataFrame:
    """``(path, locator, rank, name, similarity)``: for each distinct normalised locator of
    ``citations`` the ``most`` nearest names of ``sections`` with its path, nearest first, ties by
    name.  Similarity is one minus edits over the longer length, ``least`` or more (above 0.5).

    No name that near is missed, and no locator meets all names: each edit spoils at most two
    letter pairs, so near names share many, and then they share one among the few rarest of
    each; only such pairs of names are compared.  Equal names are one; null and empty ones, and
    those of a null path, take no part.  Empty tables give no rows.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must be above 0.5 and at most 1")
    side = lambda rows, cited: rows.select("path", norm_locator(F.col("locator")).alias("name"), F.lit(cited).alias("cited"))
    both = side(citations, True).unionByName(side(sections, False)).where("path is not null and name <> ''")
    names = both.groupBy("path", "name").agg(F.max("cited").alias("cited"), F.max(~F.col("cited")).alias("named"))
    size = F.length("name")
    pairs = materialize(names.select("*", size.alias("size"), F.inline(_letter_pairs(F.col("name")))), "pairs")
    known = pairs.groupBy("pair", "nth").agg(F.count("*").alias("df"))
    rarest = F.row_number().over(W.partitionBy("path", "name").orderBy("df", "pair", "nth"))
    shared = F.ceil((2 * least - 1) * F.col("size") - EDGE) + 1
    few = pairs.join(known, ["pair", "nth"]).withColumn("at", rarest).where(F.col("at") <= F.col("size") + 2 - shared)
    few = materialize(few.select("path", "pair", "nth", "name", "size", "cited", "named"), "rarest")
    asked = few.where("cited").select("path", "pair", "nth", F.col("name").alias("locator"), F.col("size").alias("own"))
    longer, shorter = F.greatest("own", "size"), F.least("own", "size")
    met = asked.join(few.where("named"), ["path", "pair", "nth"]).where(shorter >= least * longer - EDGE)
    met = met.select("path", "locator", "name", longer.alias("longer")).distinct()
    edits = met.withColumn("edits", F.levenshtein("locator", "name")).where(F.col("edits") <= (1 - least) * F.col("longer") + EDGE)
    found = edits.select("path", "locator", "name", (1 - F.col("edits") / F.col("longer")).alias("similarity"))
    rank = F.row_number().over(W.partitionBy("path", "locator").orderBy(F.desc("similarity"), "name"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("path", "locator", "rank", "name", "similarity")
