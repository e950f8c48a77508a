"""Views over nested records: rubrics, media choices, reading order, what needs attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rubric_feedback(rubric: Column, assessment: Column) -> Column:
    """Lines such as ``Clarity: 3/5 (Good) - nice`` of the criteria that were assessed.

    ``rubric`` is an array of (id, description, points, ratings), ``assessment`` a map from
    criterion to (points, rating_id, comments).
    """

    def line(c: Column) -> Column:
        own = F.try_element_at(assessment, c["id"])
        rating = F.get(F.filter(c["ratings"], lambda r: r["id"] == own["rating_id"]), F.lit(0))["description"]
        number = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
        return F.when(own.isNotNull(), F.concat(
            c["description"], F.lit(": "), F.coalesce(number(own["points"]), F.lit("-")), F.lit("/"), F.coalesce(number(c["points"]), F.lit("-")),
            F.coalesce(F.concat(F.lit(" ("), rating, F.lit(")")), F.lit("")),
            F.coalesce(F.concat(F.lit(" - "), F.nullif(F.trim(own["comments"]), F.lit(""))), F.lit("")),
        ))

    return F.array_compact(F.transform(rubric, line))


def media_source(sources: Column) -> Column:
    """The smallest usable source of (url, type, size, bitrate): sound first, then MP4, then any."""
    tier = lambda s: F.when(F.startswith(s["type"], F.lit("audio/")), 0).when(F.contains(s["type"], F.lit("mp4")), 1).otherwise(2)
    usable = F.filter(sources, lambda s: s["url"].isNotNull() & (s["url"] != ""))
    ranked = F.transform(usable, lambda s: F.struct(tier(s).alias("t"), F.coalesce(s["size"], s["bitrate"], F.lit(1 << 62)).alias("z"), s["url"].alias("url")))
    return F.array_min(ranked)["url"]


def reading_order(items: DataFrame, page: str, tolerance: float = 0.01) -> DataFrame:
    """``items`` (x, y, w, text) with ``nth``: full-width items split a page into bands, a
    band's columns are read one after the other, and rows of a column from the top."""
    wide = F.col("w") > 0.6
    by_y = W.partitionBy(page).orderBy("y", "x")
    band = F.sum(wide.cast("int")).over(by_y) * 2 - wide.cast("int")
    row = F.floor(F.col("y") / tolerance)
    column = F.when(wide, 0).otherwise((F.col("x") + F.col("w") / 2 > 0.5).cast("int"))
    rows = items.withColumns({"__band": band, "__column": column, "__row": row})
    nth = F.row_number().over(W.partitionBy(page).orderBy("__band", "__column", "__row", "x"))
    return rows.withColumn("nth", nth).drop("__band", "__column", "__row")


def attention(items: DataFrame, key: str) -> DataFrame:
    """``(key, waiting, failed, reason)``: what is not there yet, and the commonest reason."""
    failed = items.where("status = 'failed'")
    reasons = failed.groupBy(key, "error").count().groupBy(key).agg(F.max_by("error", F.struct("count", "error")).alias("reason"))
    counts = items.groupBy(key).agg(F.count_if(F.col("status") == "pending").alias("waiting"), F.count_if(F.col("status") == "failed").alias("failed"))
    return counts.where("waiting > 0 or failed > 0").join(reasons, key, "left")


def grouped_hits(hits: DataFrame, path: str, text: str) -> DataFrame:
    """Hits with one row for each text: where it was found first, and the other places."""
    folded = F.lower(F.regexp_replace(F.col(text), r"\s+", " "))
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(path).alias("p"))))
    return hits.groupBy(F.sha2(folded, 256).alias("__same")).agg(F.min_by(text, "rank").alias(text), ordered.alias("o")).select(
        F.col("o")[0]["rank"].alias("rank"), F.col("o")[0]["p"].alias(path), text, F.transform(F.slice("o", 2, 1_000_000), lambda x: x["p"]).alias("also")
    )


def export_manifest(documents: DataFrame, links: DataFrame, modules: DataFrame, folder: str) -> DataFrame:
    """What a pack of the given modules holds: each linked document once, with its target."""
    wanted = links.join(modules, "module", "left_semi").groupBy("path").agg(F.min("module").alias("module"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = documents.join(wanted, "path").select("path", "module", F.concat_ws("/", F.lit(folder), "module", name).alias("target"))
    nth = F.row_number().over(W.partitionBy(F.lower("target")).orderBy("path"))
    return rows.withColumn("target", F.when(nth == 1, F.col("target")).otherwise(F.regexp_replace("target", r"^(.*?)(\.[^./]*)?$", F.concat(F.lit("$1 ("), nth.cast("string"), F.lit(")$2")))))
