"""Usage and delays over weeks and months from sketches stored per day.

Days are summed up once. A longer period merges the sketches of its days and never
reads an event again: distinct users of a week are not the sum of its days' users, and a
median of medians is no median, but sketches of both kinds can be united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^14 registers: a standard error of about 0.8 % of the distinct values.
HLL_BITS = 14
#: Rank error of a quantile, about 0.7 %.
KLL_SIZE = 400


def daily_usage(activity: DataFrame) -> DataFrame:
    """A row per day: exact sums, and sketches of its users and articles.

    ``activity`` as in :func:`feedlake.operators.insights.kpi_daily`. Sketches are built on
    the map side; a hot day meets as one sketch per task.
    """
    return activity.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("is_view").alias("views"),
        F.count_if("is_interaction").alias("interactions"),
        F.hll_sketch_agg(F.col("user_id").cast("string"), HLL_BITS).alias("users"),
        F.hll_sketch_agg(F.col("article_id").cast("string"), HLL_BITS).alias("articles"),
    )


def usage_over(daily: DataFrame, period: str) -> DataFrame:
    """Days merged to a ``period`` ("week", "month", "quarter", "year"): exact sums and
    rate, estimated active users and articles."""
    return daily.groupBy(_start(period)).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("events").alias("events"),
        (F.sum("interactions") / F.nullif(F.sum("views"), F.lit(0))).alias("interaction_rate"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("active_users"),
        F.hll_sketch_estimate(F.hll_union_agg("articles")).alias("articles"),
    )


def daily_delays(deliveries: DataFrame, *by: str) -> DataFrame:
    """A row per day of delivery and ``by``: how many, the longest, and a sketch of all
    delays in hours. ``deliveries``: published_at, delivered_at, ``by``."""
    micros = F.unix_micros(F.col("delivered_at").cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))
    hours = deliveries.withColumn("hours", micros / 3_600_000_000).where("hours is not null")
    return hours.groupBy(F.to_date("delivered_at").alias("day"), *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("hours").alias("longest"),
        F.kll_sketch_agg_double("hours", KLL_SIZE).alias("delays"),
    )


def delays_over(daily: DataFrame, period: str, *by: str) -> DataFrame:
    """Days merged to a ``period``: exact count and longest delay, estimated median and
    95th percentile."""
    merged = daily.groupBy(_start(period), *by).agg(
        F.sum("n").alias("n"), F.max("longest").alias("longest"), F.kll_merge_agg_double("delays", KLL_SIZE).alias("delays")
    )
    quantile = F.kll_sketch_get_quantile_double
    return merged.select(
        "period_start", *by, "n", "longest",
        quantile("delays", F.lit(0.5)).alias("p50_hours"),
        quantile("delays", F.lit(0.95)).alias("p95_hours"),
    )


def _start(period: str) -> Column:
    return F.to_date(F.date_trunc(period, "day")).alias("period_start")
