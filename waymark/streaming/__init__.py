"""Structured Streaming forms of the order-sensitive operators; extensions, as the catalog itself is static."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Gap clusters of a stream: session windows of each key, final once the watermark passes them."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_only(responses: DataFrame, key: str, sequence: str) -> DataFrame:
    """The response with the greatest sequence number of each key, for the update mode: a response that comes late changes nothing. State is one row for each key."""
    others = [c for c in responses.columns if c != key]
    newest = F.max_by(F.struct(*others), sequence).alias("newest")
    return responses.groupBy(key).agg(newest).select(key, "newest.*")


def periodically(spark: SparkSession, compute, write, every: str = "30 seconds", checkpoint: str | None = None):
    """Run ``write(compute(now))`` in every interval, ``now`` being the time of the trigger; returns the running query. Intervals that are missed are not made up for."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def again(_, number: int) -> None:
        write(compute(datetime.now(timezone.utc)))

    writer = ticks.writeStream.foreachBatch(again).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def counts(events: DataFrame, key: str, at: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each key in tumbling windows of event time."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")
