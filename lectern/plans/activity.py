"""Practice, session and stream-like queries over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import coverage, folds, practice
from lectern.plans.tables import table

NOW = 1706745600  # 2024-02-01, UTC
GAP = 6 * 3600


def seconds(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are good answers, errors wrong ones, clicks hard ones."""
    rating = F.when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "click", "hard").otherwise("again")
    rows = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error', 'click')")
    return rows.select("user_id", "event_id", seconds("ts").alias("at"), rating.alias("rating"), (F.col("event_type") == "purchase").alias("correct"))


def accuracy_first_latest_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = practice.accuracy(_attempts(spark, sf_dir), "user_id", "event_id", "correct")
    return found.select("user_id", "first", "latest", "recent", "attempts")


def review_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return practice.review_schedule(_attempts(spark, sf_dir), "user_id", "at", "rating")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in the order in which they are due, weak ones before scheduled ones."""
    attempts = _attempts(spark, sf_dir)
    joined = practice.review_schedule(attempts, "user_id", "at", "rating").join(practice.accuracy(attempts, "user_id", "event_id", "correct"), "user_id")
    queue = practice.review_queue(joined, NOW, F.col("recent") < 0.3)
    return queue.select("user_id", "priority", "due")


def difficulty_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view", "signup", "purchase", "error"]
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).count().na.fill(0)


def tumbling_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly buckets of a user's events, labelled by the first."""
    at = seconds("ts")
    return table(spark, sf_dir, "events").groupBy("user_id", F.floor(at / 3600).alias("bucket")).agg(
        F.min(at).alias("first"), F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")
    )


def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: a user's events with less than six hours between them."""
    rows = table(spark, sf_dir, "events").select("user_id", seconds("ts").alias("at"), "value")
    grouped = coverage.gap_groups(rows, ["user_id"], "at", GAP)
    return grouped.groupBy("user_id", "group").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("events"))


def keyframe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events kept as key frames: the value moved by over 12 and an hour passed since the last kept."""
    rows = table(spark, sf_dir, "events").select("user_id", seconds("ts").alias("at"), "value")
    return folds.key_frames(rows, "user_id", "at", "value", change=12.0, gap=3600)


def attempt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt with the schedule after it; views are reveals, and half of the users answer by choice."""
    rating = F.when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "click", "hard").when(F.col("event_type") == "view", "reveal")
    steps = table(spark, sf_dir, "events").where("event_type <> 'signup'").select(
        "user_id", "event_id", seconds("ts").alias("at"), F.coalesce(rating, F.lit("again")).alias("kind"), (F.col("user_id") % 2 == 0).alias("choice")
    )
    return practice.attempt_history(steps, "user_id", "at", "event_id", "kind", "choice")


def caption_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose text repeats or extends the last kept turn's are merged into it."""
    return folds.collapse_captions(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def last_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(best.alias("m")).select("user_id", "event_type", "m.event_id", "m.value")


def thread_instructor_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that follow a user's turn, with the length of what they answer."""
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"was": F.lag("role").over(order), "asked": F.length(F.lag("text").over(order))})
    replies = rows.where("role = 'assistant' and was = 'user'")
    return replies.select("conv_id", "turn", F.col("asked").cast("long").alias("asked_chars"), F.length("text").cast("long").alias("chars"))


def event_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.sum(k).alias("total"), F.min(k).alias("least"), F.max(k).alias("most"), F.count(k).alias("n"), F.median(k).alias("middle")
    )


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        accuracy_first_latest_recent, review_schedule, review_queue, difficulty_histogram, tumbling_buckets, gap_groups,
        keyframe_fold, attempt_history, caption_collapse, last_attempt, thread_instructor_replies, event_json_props, daily_counts,
    )
}

_ATTEMPTS = """attempt AS (
  SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS sec, event_type = 'purchase' AS correct,
         CASE event_type WHEN 'purchase' THEN 'good' WHEN 'click' THEN 'hard' ELSE 'again' END AS rating
  FROM events WHERE event_type IN ('purchase', 'error', 'click'))"""
_ACCURACY = """accuracy AS (
  SELECT user_id, min_by(correct::INT::DOUBLE, event_id) AS first, max_by(correct::INT::DOUBLE, event_id) AS latest,
         round(avg(correct::INT::DOUBLE) FILTER (nth <= 20), 3) AS recent, count(*) AS attempts
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM attempt) GROUP BY user_id)"""
_SCHEDULE = """ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, rating) AS nth FROM attempt),
walk AS (
  SELECT user_id, 0::BIGINT AS nth, 0 AS streak, NULL::BIGINT AS due FROM (SELECT DISTINCT user_id FROM attempt)
  UNION ALL
  SELECT user_id, nth, streak, sec + CASE rating WHEN 'good' THEN [1, 3, 7, 14, 30][least(streak, 5)] * 86400 WHEN 'hard' THEN 86400 ELSE 600 END
  FROM (SELECT o.user_id, o.nth, o.sec, o.rating,
               CASE WHEN o.rating <> 'good' THEN 0 WHEN w.due IS NULL OR o.sec >= w.due THEN w.streak + 1 ELSE greatest(1, w.streak) END AS streak
        FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.nth = w.nth + 1)),
schedule AS (SELECT user_id, max_by(streak, nth) AS streak, max_by(due, nth) AS due FROM walk GROUP BY user_id)"""

ORACLES = {
    "accuracy_first_latest_recent": f"WITH {_ATTEMPTS}, {_ACCURACY} SELECT * FROM accuracy",
    "review_schedule": f"WITH RECURSIVE {_ATTEMPTS}, {_SCHEDULE} SELECT user_id, streak::INT AS streak, due FROM schedule",
    "review_queue": f"""WITH RECURSIVE {_ATTEMPTS}, {_ACCURACY}, {_SCHEDULE}
SELECT schedule.user_id, (CASE WHEN due <= {NOW} THEN 0 WHEN recent < 0.3 THEN 1 WHEN due IS NULL THEN 2 ELSE 3 END)::INT AS priority, due
FROM schedule JOIN accuracy ON schedule.user_id = accuracy.user_id""",
    "difficulty_histogram": """
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'signup') AS signup,
       count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id""",
    "tumbling_buckets": """
SELECT user_id, (epoch(date_trunc('hour', ts)) / 3600)::BIGINT AS bucket, epoch(date_trunc('second', min(ts)))::BIGINT AS first, count(*) AS events,
       round(sum(value), 4) AS value FROM events GROUP BY user_id, bucket""",
    "gap_groups": f"""
WITH e AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS sec FROM events),
g AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) > {GAP} THEN 1 ELSE 0 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY sec) AS grp FROM g)
SELECT user_id, grp::BIGINT AS "group", min(sec) AS first, max(sec) AS last, count(*) AS events FROM s GROUP BY user_id, grp""",
    "keyframe_fold": """
WITH RECURSIVE frame AS (
  SELECT user_id, sec, value, row_number() OVER (PARTITION BY user_id ORDER BY sec, value) AS nth
  FROM (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS sec, value FROM events) WHERE sec IS NOT NULL AND value IS NOT NULL),
walk AS (
  SELECT user_id, nth, true AS keep, sec AS last_sec, value AS last_value, 1 AS kept FROM frame WHERE nth = 1
  UNION ALL
  SELECT user_id, nth, keep, CASE WHEN keep THEN sec ELSE last_sec END, CASE WHEN keep THEN value ELSE last_value END, kept + keep::INT
  FROM (SELECT f.user_id, f.nth, f.sec, f.value, w.last_sec, w.last_value, w.kept,
               w.kept < 200 AND abs(f.value - w.last_value) > 12 AND f.sec - w.last_sec >= 3600 AS keep
        FROM walk w JOIN frame f ON f.user_id = w.user_id AND f.nth = w.nth + 1))
SELECT user_id, last_sec AS "at", last_value AS value FROM walk WHERE keep""",
    "attempt_history": """
WITH RECURSIVE step AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS nth
  FROM (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS sec, user_id % 2 = 0 AS choice,
               CASE event_type WHEN 'purchase' THEN 'good' WHEN 'click' THEN 'hard' WHEN 'view' THEN 'reveal' ELSE 'again' END AS kind
        FROM events WHERE event_type <> 'signup')),
walk AS (
  SELECT user_id, 0::BIGINT AS nth, NULL::BIGINT AS event_id, 'start' AS kind, 0 AS streak, NULL::BIGINT AS due, false AS assisted, false AS seen, false AS fresh
  FROM (SELECT DISTINCT user_id FROM step)
  UNION ALL
  SELECT user_id, nth, event_id, kind, streak,
         CASE kind WHEN 'reveal' THEN due WHEN 'good' THEN sec + [1, 3, 7, 14, 30][least(streak, 5)] * 86400 WHEN 'hard' THEN sec + 86400 ELSE sec + 600 END,
         seen, CASE WHEN kind <> 'reveal' THEN false WHEN choice AND fresh THEN seen ELSE true END,
         CASE WHEN kind <> 'reveal' THEN true WHEN choice THEN false ELSE fresh END
  FROM (SELECT s.user_id, s.nth, s.event_id, s.kind, s.sec, s.choice, w.due, w.seen, w.fresh,
               CASE WHEN s.kind = 'reveal' THEN w.streak WHEN s.kind <> 'good' THEN 0 WHEN w.due IS NULL OR s.sec >= w.due THEN w.streak + 1
                    ELSE greatest(1, w.streak) END AS streak
        FROM walk w JOIN step s ON s.user_id = w.user_id AND s.nth = w.nth + 1))
SELECT user_id, event_id, streak::INT AS streak, due, assisted FROM walk WHERE kind NOT IN ('start', 'reveal')""",
    "caption_collapse": """
WITH RECURSIVE caption AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS nth FROM conversations WHERE text IS NOT NULL),
walk AS (
  SELECT conv_id, nth, turn, text, nth AS own FROM caption WHERE nth = 1
  UNION ALL
  SELECT w.conv_id, c.nth,
         CASE WHEN ends_with(w.text, c.text) OR starts_with(c.text, w.text) THEN w.turn ELSE c.turn END,
         CASE WHEN ends_with(w.text, c.text) THEN w.text ELSE c.text END,
         CASE WHEN ends_with(w.text, c.text) OR starts_with(c.text, w.text) THEN w.own ELSE c.nth END
  FROM walk w JOIN caption c ON c.conv_id = w.conv_id AND c.nth = w.nth + 1)
SELECT conv_id, max_by(turn, nth) AS turn, max_by(text, nth) AS text FROM walk GROUP BY conv_id, own""",
    "last_attempt": """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1""",
    "thread_instructor_replies": """
SELECT conv_id, turn, asked::BIGINT AS asked_chars, length(text)::BIGINT AS chars FROM (
  SELECT *, lag(role) OVER w AS was, length(lag(text) OVER w) AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant' AND was = 'user'""",
    "event_json_props": """
SELECT event_type, sum(k)::BIGINT AS total, min(k) AS least, max(k) AS most, count(k) AS n, median(k)::DOUBLE AS middle
FROM (SELECT event_type, (props->>'$.k')::INT AS k FROM events) GROUP BY event_type""",
    "daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
