"""Time windows over event streams, in batch and in Structured Streaming.

The engine's own plans are all bounded; this is the same aggregate for sources that are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; on a stream, rows up to `late` behind are counted.

    Partial aggregates are made before the shuffle, and the watermark bounds the state.
    """
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    counted = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")
