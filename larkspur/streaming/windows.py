"""Event-time windows over a stream of events: an extension, not part of the reference's language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of value for each window and event type; rows later than the watermark are dropped by Spark."""
    got = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "total")
