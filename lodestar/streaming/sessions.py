"""Event-time windows: sessions that end with a silence, and tumbling windows; late events are dropped by a watermark.

The same plan runs over a table, where every event counts, and over a stream, where the state of a window is kept
until the watermark has passed its end. Sessions are aggregated in each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str | None = "1 hour", value: str | None = None) -> DataFrame:
    """(key, started, ended, n, total) of each session of a key: events less than ``gap`` apart belong together.

    ``ended`` is the last event's time plus the gap. Events without a time or key take no part. ``late`` is how
    long after the newest event an event of a stream may still arrive."""
    rows = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull())
    if late and rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    total = F.sum(value) if value else F.lit(None).cast("double")
    made = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), *([total.alias("total")] if value else []))
    return made.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", *(["total"] if value else []))


def tumbling(events: DataFrame, by: str, ts: str = "ts", width: str = "1 hour", late: str | None = "10 minutes", value: str = "value") -> DataFrame:
    """(by, started, n, total) of each window of ``width`` in which there are events."""
    rows = events.where(F.col(ts).isNotNull())
    if late and rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    made = rows.groupBy(by, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return made.select(by, F.col("w.start").alias("started"), "n", "total")
