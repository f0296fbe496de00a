"""Event windows and incremental ingestion, for tables and for streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value); `late` is the watermark of a stream."""
    own = events.withWatermark("ts", late) if late else events
    by = own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with less than `gap` between neighbours; end is the last event."""
    own = events.withWatermark("ts", late) if late else events
    by = own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    return by.select("user_id", F.col("w.start").alias("start"), "end", "n")


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, late: str = "1 day"):
    """Start a stream of documents (doc_id, text, ts) whose repeated contents within the watermark are dropped; each
    batch goes to `handle` with its number, which makes a retried batch recognisable."""
    fresh = stream.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])
    return fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
