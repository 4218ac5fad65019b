"""Freshness of arrivals on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from feedlake.operators.insights import freshness


def stream_freshness(
    arrivals: DataFrame, delay: str = "10 minutes", width: str = "5 minutes"
) -> DataFrame:
    """Per-window freshness; rows later than ``delay`` no longer count.

    ``arrivals``: a stream with ts and lag_minutes. State is one row per open
    window, whatever the volume.
    """
    return freshness(arrivals.withWatermark("ts", delay), width)
