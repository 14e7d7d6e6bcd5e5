"""Streams (T1-T6): the usage log folded, sessions closed after quiet, files discovered once, late rows replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.operators.usage import folded, parse_log


def usage_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The running fold of usage logs that are added to a folder; update mode gives the documents that changed."""
    lines = spark.readStream.format("text").load(folder)
    return folded(parse_log(lines))


def quiet_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user, started, ended, events) of sessions that a gap has closed. Batch or stream; a stream emits a session once the watermark passed it."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    s = e.groupBy(F.col(user), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def once_within(events: DataFrame, key: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """T5: rows delivered again within the watermark are dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def young(events: DataFrame, ts: str, now: str, days: int) -> DataFrame:
    """Rows not older than a number of days."""
    return events.filter(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def run_into(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update"):
    """One pass over what a source has new since the checkpoint, each batch given to write with its number.

    The checkpoint remembers which files were read; write must be idempotent for a batch number, as a failed batch is given again.
    """
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
