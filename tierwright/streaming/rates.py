"""Rates over event streams. An extension: the operators of ``functions.stats`` on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwright.functions import stats


def windowed_rates(events: DataFrame, threshold: float, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window, event_type and the rate of values above a threshold; works on streams and on tables alike.

    Events later than ``late`` behind the newest are dropped by a stream, as the watermark says.
    """
    # watermarks know no timestamps without a time zone
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    counts = marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count_if(F.col("value") > threshold).alias("k"), F.count("*").alias("all"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", *stats.rate(F.col("k"), F.col("all")))
