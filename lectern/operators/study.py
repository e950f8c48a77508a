"""Units of documents, what notes cite of them, and where studying stands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.predicates import worth_describing
from lectern.functions.text import unit_numbers
from lectern.operators.coverage import islands, worded

# Formats of a unit's heading, of its visual note, and of a description.
UNIT = r"^\[(Page|Slide|Sheet:|Cell|Image)\s*([^\]]*)\]\s*(.*)$"
VISUAL = r"(?m)^> Visual content: (.+?)\. View"
DESCRIBED = "> **What this shows**"
LEAST_TEXT = 25


def units(sections: DataFrame, key: str = "path") -> DataFrame:
    """``(key, sec_no, kind, num, title, visual, described, has_text)`` of the sections that
    are pages, slides, sheets, cells or images."""
    body = F.regexp_replace(F.regexp_replace("text", r"(?m)^>.*$", ""), r"\s+", " ")
    found = sections.withColumn("kind", F.regexp_replace(F.regexp_extract("heading", UNIT, 1), ":", "")).where("kind <> ''")
    visual = F.nullif(F.regexp_extract("text", VISUAL, 1), F.lit(""))
    return found.select(
        key, "sec_no", "kind", F.regexp_extract("heading", UNIT, 2).try_cast("int").alias("num"), F.trim(F.regexp_extract("heading", UNIT, 3)).alias("title"),
        visual.alias("visual"), F.contains("text", F.lit(DESCRIBED)).alias("described"), (F.length(F.trim(body)) >= LEAST_TEXT).alias("has_text"),
    )


def visual_survey(rows: DataFrame, key: str = "path", first: int = 20) -> DataFrame:
    """Visual units of each document: how many, how many described, and the first to do."""
    seen = rows.where(F.coalesce(worth_describing(F.col("visual")), F.lit(False)))
    todo = F.sort_array(F.collect_list(F.when(~F.col("described"), F.struct("sec_no", "kind", "num"))))
    return seen.groupBy(key).agg(F.count("*").alias("total"), F.count_if("described").alias("described"), F.slice(todo, 1, first).alias("todo"))


def missed_units(rows: DataFrame, notes: DataFrame, key: str = "path") -> DataFrame:
    """``(key, units)``: numbered units with text or visuals that a document's notes do not
    name, worded as ranges.  Documents without notes are left out."""
    cited = notes.select(key, F.explode(unit_numbers(F.col("note"))).alias("num"))
    expected = rows.where("num is not null and (has_text or visual is not null)").join(notes.select(key).distinct(), key, "left_semi")
    missed = expected.select(key, "num").distinct().join(cited, [key, "num"], "left_anti")
    return worded(islands(missed, [key], "num"), [key])


def study_status(documents: DataFrame, notes: DataFrame, missed: DataFrame, key: str = "path") -> DataFrame:
    """``(key, state)``: done; missing references; changed since its notes; same content as
    a studied twin; or no notes."""
    own = notes.select(key, F.col("fingerprint").alias("noted"))
    joined = documents.select(key, "fingerprint").join(own, key, "left").join(missed.select(key, F.lit(True).alias("gaps")), key, "left")
    studied = documents.join(own, key).where("fingerprint = noted").select("fingerprint").distinct().withColumn("twin", F.lit(True))
    state = (
        F.when(F.col("noted").isNotNull() & (F.col("noted") != F.col("fingerprint")), "changed")
        .when(F.col("noted").isNotNull() & F.col("gaps"), "missing references").when(F.col("noted").isNotNull(), "done")
        .when(F.col("twin"), "same content").otherwise("no notes")
    )
    return joined.join(studied, "fingerprint", "left").select(key, state.alias("state"))


def course_walk(sources: Sequence[DataFrame], key: str = "path") -> DataFrame:
    """Documents in the order in which a course leads to them: sources after each other, each
    by ``position``; a document is where it is met first."""
    every = None
    for n, source in enumerate(sources):
        rows = source.select(key, "position", F.lit(n).alias("source"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy(key).agg(F.min(F.struct("source", "position")).alias("m")).select(key, "m.source", "m.position")


def newest_notes(notes: DataFrame, key: str = "path") -> DataFrame:
    """The newest notes of each document, from a table that is only appended to."""
    order = W.partitionBy(key).orderBy(F.desc("date"), F.desc("note"))
    return notes.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
