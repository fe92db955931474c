"""Event-time aggregates on streams: an extension, not among the blueprint's operators.

The same functions work on batch tables and on streams; on streams the
watermark bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Count and sum per window and key; ``late`` is the watermark's delay."""
    rows = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def first_of_key(events: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """One event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
