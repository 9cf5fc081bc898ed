"""Weekly cohorts of a stream, and how much of it came too late."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# Weeks start on Monday; the epoch was a Thursday, so the first Monday is four days in.
WEEK = "7 days"
MONDAY = "4 days"


def weekly_counts(events: DataFrame, time: str, keys: list[str], delay: str | None) -> DataFrame:
    """Rows per Monday-aligned week and key; works on batches and streams alike.

    A stream forgets a week ``delay`` after its end and drops what comes later for it. With None it forgets nothing and
    drops nothing; its state then grows with weeks and keys.
    """
    source = events.withWatermark(time, delay) if events.isStreaming and delay else events
    weeks = source.groupBy(F.window(time, WEEK, startTime=MONDAY).alias("w"), *keys).agg(F.count("*").alias("n"))
    return weeks.select(F.col("w.start").cast("date").alias("monday"), *keys, "n")


class Arrivals(StreamingQueryListener):
    """Rows that each micro-batch of one query read; a batch that runs again counts once."""

    def __init__(self):
        self.rows: dict[int, int] = {}
        self.ended = threading.Event()
        self.run = None

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        if "arrivals" in progress.observedMetrics and (self.run is None or str(progress.runId) == self.run):
            self.rows[progress.batchId] = progress.observedMetrics["arrivals"]["rows"]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.run is None or str(event.runId) == self.run:
            self.ended.set()


@dataclass(frozen=True)
class Cohorts:
    """Final counts (monday, keys, n), rows that arrived in all runs so far, and how many of them came too late."""

    counts: DataFrame
    arrived: int
    late: int


def run_weekly_counts(spark: SparkSession, stream: DataFrame, time: str, keys: list[str], root: str, delay: str | None) -> Cohorts:
    """Run a stream to its end and return the final counts.

    Each micro-batch appends the weeks it changed under its own number; the newest number of a week wins, so a repeated
    batch does no harm. Rows without a time are in no week. What every batch read is observed and kept below ``root``
    beside the weeks; rows that were read and are in no week came too late.
    """
    known = stream.where(F.col(time).isNotNull()).observe("arrivals", F.count("*").alias("rows"))

    def write(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/weeks/part={number}")

    arrivals = Arrivals()
    spark.streams.addListener(arrivals)
    try:
        query = (
            weekly_counts(known, time, keys, delay)
            .writeStream.outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", f"{root}/_stream")
            .foreachBatch(write)
            .start()
        )
        arrivals.run = str(query.runId)
        query.awaitTermination()
        arrivals.ended.wait(60)
    finally:
        spark.streams.removeListener(arrivals)
    for number, rows in arrivals.rows.items():
        spark.createDataFrame([(rows,)], "rows long").coalesce(1).write.mode("overwrite").parquet(f"{root}/arrivals/part={number}")
    changes = spark.read.parquet(f"{root}/weeks")
    counts = changes.groupBy("monday", *keys).agg(F.max_by("n", "batch").alias("n"))
    arrived = spark.read.schema("rows long").parquet(f"{root}/arrivals").agg(F.sum("rows")).first()[0] or 0
    return Cohorts(counts, arrived, arrived - (counts.agg(F.sum("n")).first()[0] or 0))
