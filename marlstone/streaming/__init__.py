"""Extension: signals over streams.  What the batch operators state has no streaming counterpart of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_activity(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and type of a stream (or table) ``events(ts, event_type)``, under a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")
