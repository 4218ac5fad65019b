"""The summarisation work list: what is missing, how good, how much it costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions.tokens import sentences
from feedlake.session import materialize


def needs_summary(candidates: DataFrame, summaries: DataFrame, model: str) -> DataFrame:
    """Candidates without a summary by ``model``."""
    done = summaries.filter(F.col("model") == model).select("article_id")
    return candidates.join(done, "article_id", "left_anti").withColumn("model", F.lit(model))


def check_summaries(
    summaries: DataFrame, text: str, settings: C.SummarySettings = C.SummarySettings()
) -> DataFrame:
    """Sentence count, status and the text to store.

    2-3 sentences are valid, of more the first three are kept, fewer ask for a
    longer summary.
    """
    n = F.size("_sentences")
    status = (
        F.when(n > settings.max_sentences, F.lit("truncated"))
        .when(n >= settings.min_sentences, F.lit("valid"))
        .otherwise(F.lit("too_short"))
    )
    kept = F.array_join(F.slice("_sentences", 1, settings.max_sentences), " ")
    return (
        summaries.withColumn("_sentences", sentences(F.col(text)))
        .withColumns(
            {
                "n_sentences": n,
                "status": status,
                "stored_text": F.when(n > settings.max_sentences, kept).otherwise(F.col(text)),
            }
        )
        .drop("_sentences")
    )


def running_total(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Running sum of ``value`` per key in the order of a unique column of any type.

    A key may hold most of the rows, and its order may be sparse (hashes, times), so
    rows are cut into ranges of key and order, of like size: each range sums its own
    rows, and the totals of the ranges before are added. No window spans more than one
    range. Ranges come from a sample, so they are written once and read from there. Rows
    with a null key are one key.
    """
    ranged = rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_key{k}" for k in range(len(keys))]
    starts = totals.select(
        *(F.col(key).alias(name) for key, name in zip(keys, names, strict=True)),
        F.col("_range").alias("_of"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"),
    )
    same = F.col("_range") == F.col("_of")
    for key, name in zip(keys, names, strict=True):
        same = same & F.col(key).eqNullSafe(F.col(name))
    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.join(starts, same)
        .withColumn(out, F.col("_start") + F.sum(value).over(inside))
        .drop("_range", "_of", "_start", *names)
    )


def token_budget(
    requests: DataFrame,
    day: str,
    order: str,
    tokens: str,
    budget: int = C.SummarySettings().daily_token_budget,
) -> DataFrame:
    """Spend per day in priority order; requests past the budget are deferred."""
    spent = running_total(requests, [day], order, tokens, "spent")
    return spent.withColumn("within_budget", F.col("spent") <= F.lit(budget))


def status_distribution(checked: DataFrame, *by: str | Column) -> DataFrame:
    return checked.groupBy(*by, "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_sentences").alias("sentences")
    )
