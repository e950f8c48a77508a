"""Streaming queries, run to the end of what is there, and the SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans import activity
from lectern.streaming import events


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.finished(events.daily_counts(events.event_stream(spark, sf_dir)), "complete")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.finished(events.sessions(events.event_stream(spark, sf_dir)), "complete")


def stream_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.finished(events.review_state(events.event_stream(spark, sf_dir)), "update", ["user_id"])


def stream_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.finished(events.once(events.event_stream(spark, sf_dir)), "append")
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_sessions, stream_review_state, stream_distinct_events)}
ORACLES = {
    "stream_daily_counts": activity.ORACLES["daily_counts"],
    "stream_review_state": activity.ORACLES["review_schedule"],
    "stream_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM g)
SELECT user_id, epoch(date_trunc('second', min(ts)))::BIGINT AS first, epoch(date_trunc('second', max(ts)))::BIGINT AS last, count(*) AS events
FROM s GROUP BY user_id, nth""",
    "stream_distinct_events": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type",
}
