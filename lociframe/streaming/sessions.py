"""Interval union over a stream: events of a user that follow each other within a gap, as sessions with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Works on a batch and on a stream of events(ts, user_id, value)."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
