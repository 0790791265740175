"""Exact-key operators on streams.

Only exact keys are incremental: a complete-link cluster can change with every arrival, an
occurrence or correlation key cannot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_occurrences(stream: DataFrame, key: str = "occurrence_key", time: str = "received_at", late: str = "1 day") -> DataFrame:
    """The first arrival of every key within the watermark; state is dropped once it is passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def correlation_counts(stream: DataFrame, time: str = "received_at", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, key, n): arrivals per exact correlation key and tumbling window."""
    each = stream.withWatermark(time, late).select(time, F.explode("correlation_keys").alias("key"))
    return each.groupBy(F.window(time, window), "key").agg(F.count("*").alias("n"))
