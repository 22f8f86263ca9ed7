"""Event-time windows that run on a stream or, the same plan, on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and their value by tumbling window and type; late: the watermark, for streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "most")
