"""Daily picks, feedback and what is learned from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions.tokens import each
from feedlake.operators.dedup import first_wins
from feedlake.operators.ranking import top_per_topic


def daily_picks(
    scored: DataFrame,
    deliveries: DataFrame,
    delivery_date: Column,
    picks: int = C.RankingSettings().daily_picks,
) -> DataFrame:
    """Exactly ``picks`` articles per topic and day, where there are enough.

    An article is never delivered twice to a topic, and a topic that already has
    picks for the day is left alone.
    """
    fresh = scored.join(
        deliveries.select("topic_id", "article_id"), ["topic_id", "article_id"], "left_anti"
    )
    # Frozen topics are dropped from the few picks, not from all candidates: a
    # join on the topic alone would send a hot topic's candidates to one task.
    frozen = (
        deliveries.filter(F.col("delivery_date") == delivery_date).select("topic_id").distinct()
    )
    return (
        top_per_topic(fresh, picks, "position")
        .join(frozen, "topic_id", "left_anti")
        .withColumn("delivery_date", delivery_date)
    )


def short_topics(
    picked: DataFrame, topics: DataFrame, picks: int = C.RankingSettings().daily_picks
) -> DataFrame:
    """Topics that got fewer picks than they should."""
    counts = picked.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_picks"))
    return (
        topics.select("topic_id")
        .join(counts, "topic_id", "left")
        .withColumn("n_picks", F.coalesce("n_picks", F.lit(0)))
        .filter(F.col("n_picks") < picks)
    )


def latest_feedback(feedback: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One rating per delivery: the last one given."""
    return first_wins(feedback, key, [F.col(c).desc() for c in order])


def keyword_weights(
    rated: DataFrame,
    weights: DataFrame | None = None,
    settings: C.LearningSettings = C.LearningSettings(),
) -> DataFrame:
    """New weight per (topic_id, term) after a batch of ratings.

    ``rated``: topic_id, terms (array<string>), up (boolean). Each rating moves
    the terms of its article by the share of ups minus the share of downs:
    w' = clip(w * (1 + rate * (ups - downs) / (ups + downs))). Terms without
    ratings keep their weight; unknown terms start at 1.
    """
    votes = (
        rated.select("topic_id", "up", each(F.array_distinct("terms")).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy("topic_id", "term")
        .agg(F.count_if(F.col("up")).alias("ups"), F.count_if(~F.col("up")).alias("downs"))
    )
    if weights is None:
        joined = votes.withColumn("weight", F.lit(1.0))
    else:
        joined = votes.join(weights, ["topic_id", "term"], "full_outer")
    balance = (F.col("ups") - F.col("downs")) / (F.col("ups") + F.col("downs"))
    moved = F.coalesce("weight", F.lit(1.0)) * (
        1 + settings.learning_rate * F.coalesce(balance, F.lit(0.0))
    )
    clipped = F.least(F.greatest(moved, F.lit(settings.min_weight)), F.lit(settings.max_weight))
    return joined.select(
        "topic_id",
        "term",
        F.coalesce("ups", F.lit(0)).alias("ups"),
        F.coalesce("downs", F.lit(0)).alias("downs"),
        clipped.alias("weight"),
    )


def source_performance(
    rated: DataFrame, settings: C.LearningSettings = C.LearningSettings()
) -> DataFrame:
    """Smoothed share of ups per topic and source.

    ``rated``: topic_id, source_id, up.
    """
    n, ups = F.count(F.lit(1)), F.count_if(F.col("up"))
    return rated.groupBy("topic_id", "source_id").agg(
        n.alias("n_ratings"),
        ups.alias("ups"),
        ((ups + settings.prior_up) / (n + settings.prior_total)).alias("performance"),
    )
