"""Structured Streaming forms of the event queries.

Each function defines a stream; ``finished`` runs one over all that is there
(``availableNow``) with its state and output in the shared folder, and returns the last
result as a table, which equals the batch query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.practice import next_state
from lectern.storage import fresh_path

LATE = "2 days"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a stream with its watermark; ``ts`` is a timestamp."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = table.inputFiles()[:1] and table.inputFiles()[0].endswith("/events.parquet")  # a file, not a folder of files
    reader = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet" if one else "*.parquet")
    rows = reader.parquet(sf_dir if one else f"{sf_dir}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def daily_counts(events: DataFrame) -> DataFrame:
    found = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    found = events.groupBy("user_id", F.session_window("ts", gap)).agg(
        F.count("*").alias("events"), F.min(F.unix_timestamp("ts")).alias("first"), F.max(F.unix_timestamp("ts")).alias("last")
    )
    return found.select("user_id", "first", "last", "events")


def once(events: DataFrame) -> DataFrame:
    """Events without those that repeat an id within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def _review(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    streak, due = state.get if state.exists else (0, None)
    rows = pd.concat(list(batches)).sort_values(["at", "rating"])
    for at, rating in zip(rows["at"], rows["rating"], strict=True):
        streak, due = next_state(int(streak), due, int(at), rating)
    state.update((int(streak), due))
    yield pd.DataFrame({"user_id": [key[0]], "streak": [int(streak)], "due": [due]})


def review_state(events: DataFrame) -> DataFrame:
    """The review schedule, kept per user as attempts come in."""
    rating = F.when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "click", "hard").otherwise("again")
    attempts = events.where("event_type in ('purchase', 'error', 'click')").select("user_id", F.unix_timestamp("ts").alias("at"), rating.alias("rating"))
    return attempts.groupBy("user_id").applyInPandasWithState(
        _review, "user_id long, streak int, due long", "streak int, due long", "update", GroupStateTimeout.NoTimeout
    )


def finished(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run ``stream`` over all that is there; of updates, the last for each of ``keys``."""
    spark = stream.sparkSession
    folder = fresh_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    if mode == "update" and keys:
        rest = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("m")).select(*keys, "m.*")
    return rows.drop("batch")
