"""Captions (WebVTT and SRT) as segments, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})"
# Entities that captions use.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def seconds_of(time: Column) -> Column:
    """Seconds of ``[hours:]minutes:seconds.fraction``."""
    parts = F.reverse(F.split(F.replace(time, F.lit(","), F.lit(".")), ":"))
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)).cast("double"), F.lit(0.0))
    return at(0) + at(1) * 60 + at(2) * 3600


def segments(captions: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, seq, start, end, text)`` of every cue with words; tags and positions go."""
    clean = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    cues = captions.select(key, F.posexplode(F.split(clean, r"\n[ \t]*\n")).alias("seq", "cue"))
    body = F.regexp_replace(F.regexp_extract("cue", TIME + r"[^\n]*\n([\s\S]*)", 3), r"<[^>]*>|\{[^}]*\}", "")
    for entity, sign in ENTITIES.items():
        body = F.replace(body, F.lit(entity), F.lit(sign))
    found = cues.where(F.col("cue").rlike(TIME)).select(
        key, "seq", seconds_of(F.regexp_extract("cue", TIME, 1)).alias("start"), seconds_of(F.regexp_extract("cue", TIME, 2)).alias("end"),
        F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"),
    )
    return found.where("text <> ''")


def transcript(rows: DataFrame, key: str, block: int = 60) -> DataFrame:
    """Segments in blocks of ``block`` seconds, each labelled by its first start."""
    parts = F.sort_array(F.collect_list(F.struct("start", "seq", "text")))
    return rows.groupBy(key, F.floor(F.col("start") / block).alias("block")).agg(
        F.min("start").alias("start"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text")
    )


def preferred_track(tracks: DataFrame, key: str) -> DataFrame:
    """One track of each recording: English first, then subtitles before captions."""
    english = F.when(F.lower(F.col("locale")).startswith("en"), 0).otherwise(1)
    kind = F.when(F.col("kind") == "subtitles", 0).when(F.col("kind") == "captions", 1).otherwise(2)
    best = F.min(F.struct(english.alias("a"), kind.alias("b"), "locale", "kind", "id"))
    return tracks.groupBy(key).agg(best.alias("m")).select(key, "m.locale", "m.kind", "m.id")
