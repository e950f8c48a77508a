"""Sentences that speak of an exam or stress something, from the texts of a course."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import predicates
from lectern.functions.text import iso_time
from lectern.operators.sections import sections

# Buckets where stress alone counts, characters of an excerpt and of the least sentence, entries shown.
STRESSED = ("transcript", "announcement", "syllabus", "page", "discussion")
EXCERPT, LEAST, SHOWN = 320, 12, 150
# Where a sentence ends, and the signs that are taken off its ends.
ENDS = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])|\n\s*[-*•]\s+|\n{2,}"
EDGES = r"^[ \-*•>]+|[ \-*•>]+$"
# How a reply in a thread begins, and the mark of an instructor's.
REPLY, INSTRUCTOR = r"(?m)(?=^\s*- (?:\*\*|_\(deleted))", "(Instructor)"


def instructor_replies(section: Column) -> Column:
    """The replies of a thread whose first line says that an instructor wrote them, whole."""
    replies = F.filter(F.split(section, REPLY), lambda r: F.ltrim(r).rlike(r"^- (?:\*\*|_\(deleted)"))
    own = F.filter(replies, lambda r: F.contains(F.split(F.ltrim(r), "\n")[0], F.lit(INSTRUCTOR)))
    return F.array_join(F.transform(own, lambda r: F.array_join(F.transform(F.split(F.trim(r), "\n"), F.trim), "\n")), "\n")


def spoken_sentences(text: Column) -> Column:
    """Sentences without lines of the converter, pictures, link targets and signs of lists."""
    out = F.regexp_replace(predicates.without_boilerplate(text), r"!\[[^\]]*\]\([^)]*\)", " ")
    parts = F.split(F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1"), ENDS)
    return F.transform(F.filter(parts, lambda p: F.trim(p) != ""), lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+", " "), EDGES, ""))


def excerpt(sentence: Column, at: Column) -> Column:
    """``EXCERPT`` characters around place ``at`` (from 1), ellipses where more is left out."""
    start = F.greatest(F.lit(1), at - EXCERPT // 2)
    end = F.least(F.length(sentence), start + EXCERPT - 1)
    cut = F.concat(
        F.when(start > 1, "…").otherwise(""), F.trim(F.substring(sentence, start, end - start + 1)), F.when(end < F.length(sentence), "…").otherwise("")
    )
    return F.when(F.length(sentence) <= EXCERPT, sentence).otherwise(cut)


def exam_hints(documents: DataFrame) -> DataFrame:
    """``(course, bucket, path, sec_no, ord, heading, date, excerpt, weight)`` of documents
    (``course, path, kind, date, text``; an optional ``trusted``: whether an instructor
    started the thread, else taken for granted).

    Wordings of exams count everywhere, stress alone in the buckets of what is said to a
    class.  Of a discussion, the prompt of a trusted thread and the instructors' replies
    count.  An excerpt counts once in a course, where it comes first by path.  Weight is 2 if
    both patterns match, else 1.  Null texts have no sentence, a null kind is other.
    """
    kept = documents.withColumn("bucket", predicates.bucket(F.col("kind")))
    named = kept.select("course", "path", "bucket", "date", (F.coalesce("trusted", F.lit(True)) if "trusted" in documents.columns else F.lit(True)).alias("trusted"))
    # sections of a discussion are told apart by their headings; other texts need none
    threads = sections(kept.where("bucket = 'discussion'"), "path").join(named.where("bucket = 'discussion'"), "path")
    prompt = F.startswith(F.lower("heading"), F.lit("prompt"))
    threads = threads.withColumn("text", F.when(~prompt, instructor_replies(F.col("text"))).when(F.col("trusted"), F.col("text")))
    others = sections(kept.where("bucket <> 'discussion'"), "path").join(named.where("bucket <> 'discussion'"), "path")
    rows = threads.unionByName(others).select("course", "bucket", "path", "date", "sec_no", "heading", F.posexplode(spoken_sentences(F.col("text"))).alias("ord", "sentence"))
    told, stressed = (F.regexp_instr("sentence", F.lit(f"(?i){p}")) for p in (predicates.EXAM_WORDS, predicates.EMPHASIS))
    rows = rows.where(F.length("sentence") >= LEAST).withColumn("told", told).withColumn("stressed", stressed)
    hits = rows.where((F.col("told") > 0) | F.col("bucket").isin(*STRESSED) & (F.col("stressed") > 0))
    at = F.when(F.col("told") > 0, F.col("told")).otherwise(F.col("stressed"))
    weight = F.when((F.col("told") > 0) & (F.col("stressed") > 0), 2).otherwise(1)
    hits = hits.withColumn("excerpt", excerpt(F.col("sentence"), at)).withColumn("weight", weight)
    fold = F.sha2(F.trim(F.regexp_replace(F.lower("excerpt"), r"[^\p{L}\p{N}_]+", " ")), 256)
    place = ("path", "sec_no", "ord")
    once = hits.groupBy("course", fold.alias("fold")).agg(F.min(F.struct(*place, "bucket", "heading", "date", "excerpt", "weight")).alias("m"))
    return once.select("course", "m.bucket", *(f"m.{c}" for c in place), "m.heading", "m.date", "m.excerpt", "m.weight")


def shown_hints(hints: DataFrame, most: int = SHOWN) -> DataFrame:
    """The ``most`` hints of each bucket that a report shows, with ``place`` in it and ``found``
    in all: announcements by date, the latest first, others by weight, then put back in order."""
    order = (F.col("path"), F.col("sec_no"), F.col("ord"))
    recent = F.when(F.col("bucket") == "announcement", F.coalesce(iso_time(F.col("date")), F.lit("0001-01-01").cast("timestamp")))
    heavy = F.when(F.col("bucket") != "announcement", F.col("weight"))
    part = ("course", "bucket")
    best = hints.withColumn("recent", recent).withColumn("nth", F.row_number().over(W.partitionBy(*part).orderBy(F.desc("recent"), F.desc(heavy), *order))).where(F.col("nth") <= most)
    placed = best.withColumn("place", F.row_number().over(W.partitionBy(*part).orderBy(F.desc("recent"), *order))).drop("recent", "nth")
    return placed.join(hints.groupBy(*part).agg(F.count("*").alias("found")), list(part))
