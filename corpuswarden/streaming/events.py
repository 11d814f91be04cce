"""Browser-event counters as a stream: counts by route, kind and window with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.observations import EVENTS


def counters(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """events: ts, path, event_type. Append-mode counts; state is dropped once the watermark has passed a window."""
    known = events.where(F.col("event_type").isin(*EVENTS)).withWatermark("ts", late)
    counts = known.groupBy(F.window("ts", window).alias("w"), "path", "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "path", "event_type", "n")
