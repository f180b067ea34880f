"""Windows over monitor records, and de-duplication of review items, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums by window; records later than ``late`` are left out."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(by, window.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def first_of_kind(items: DataFrame, keys: list[str], within: str = "24 hours") -> DataFrame:
    """The first item of each kind; state older than ``within`` is dropped."""
    return items.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)
