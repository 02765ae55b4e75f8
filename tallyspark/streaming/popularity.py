"""Extension: item counts over an event stream in tumbling windows with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_popularity(stream: DataFrame, time: str = "ts", item: str = "asin", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window_start, item, n) of a stream or a table; rows later than the watermark are left out of a stream."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(time, window).alias("w"), item).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), item, "n")
