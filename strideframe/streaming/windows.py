"""Event-time summaries that work the same on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(rows: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(ts, late) if rows.isStreaming else rows


def tumbling(rows: DataFrame, key: str, value: str, ts: str = "ts", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count, mean and maximum of a value for each key and window."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = watermarked(rows, ts).groupBy(key, window.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean_value", "max_value")


def sessions(rows: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Presence of each key: runs of rows with no longer break than the gap."""
    out = watermarked(rows, ts).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
