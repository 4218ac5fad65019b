"""Delay from publication to delivery on two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_delays(
    publications: DataFrame, deliveries: DataFrame, longest: str = "7 days", delay: str = "1 hour"
) -> DataFrame:
    """Deliveries with the publication they belong to, as soon as both are there.

    ``publications``: a stream with article_id, published_at and whatever the summary is
    made by; ``deliveries``: article_id, delivered_at. Either may come first and be late
    by ``delay``. A publication is kept for ``longest``, a delivery until no publication
    before it can come, so the state holds a bounded time of both streams. Append the
    rows to a table and summarise them with
    :func:`feedlake.operators.insights.time_to_delivery`. Rows without an id or a time
    and deliveries ahead of their publication match nothing.
    """
    published = publications.where("article_id is not null").withWatermark("published_at", delay)
    delivered = (
        deliveries.where("article_id is not null")
        .select(F.col("article_id").alias("delivered_id"), "delivered_at")
        .withWatermark("delivered_at", delay)
    )
    meets = (
        (F.col("article_id") == F.col("delivered_id"))
        & (F.col("delivered_at") >= F.col("published_at"))
        & (F.col("delivered_at") <= F.col("published_at") + F.expr(f"interval {longest}"))
    )
    return published.join(delivered, meets).drop("delivered_id")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, over the progress reports
    the session keeps (``spark.sql.streaming.numRecentProgressUpdates``)."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
