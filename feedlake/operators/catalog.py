"""The source catalogue: upsert, placeholders, health and batch selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions.hashing import source_key
from feedlake.operators.dedup import first_wins
from feedlake.operators.skew import join_one_per_key

_SEEDED = ("name", "url", "credibility_score", "is_active")


def with_seed_defaults(seeds: DataFrame) -> DataFrame:
    """Missing score and flag get their defaults; a score of 0.0 stays."""
    return seeds.withColumns(
        {
            "credibility_score": F.coalesce("credibility_score", F.lit(C.DEFAULT_CREDIBILITY)),
            "is_active": F.coalesce("is_active", F.lit(True)),
        }
    )


def last_seed_wins(seeds: DataFrame, order: str) -> DataFrame:
    """One seed per feed address: the last one listed."""
    return first_wins(seeds, "feed_url", [F.col(order).desc()])


def url_clashes(sources: DataFrame) -> DataFrame:
    """Site addresses shared by several feeds (the table wants them unique)."""
    return (
        sources.groupBy("url").agg(F.count(F.lit(1)).alias("n_sources")).filter("n_sources > 1")
    )


def upsert_sources(sources: DataFrame, seeds: DataFrame, run_at: Column) -> DataFrame:
    """The next snapshot of the catalogue plus the ``action`` taken per row.

    Seeds overwrite name, url, score and flag; id and health are kept. Audit
    stamps move only when a compared column changed. ``seeds`` must hold one row
    per feed_url (see :func:`last_seed_wins`).
    """
    seeds = with_seed_defaults(seeds).select(
        "feed_url", *[F.col(c).alias(f"new_{c}") for c in _SEEDED], F.lit(True).alias("seeded")
    )
    both = sources.withColumn("stored", F.lit(True)).join(seeds, "feed_url", "full_outer")
    stored, seeded = F.col("stored").isNotNull(), F.col("seeded").isNotNull()
    changed = F.lit(False)
    for name in _SEEDED:
        changed = changed | ~F.col(name).eqNullSafe(F.col(f"new_{name}"))
    action = (
        F.when(~stored, F.lit("created"))
        .when(seeded, F.lit("updated"))
        .otherwise(F.lit("untouched"))
    )
    return both.select(
        F.coalesce("id", source_key(F.col("feed_url"))).alias("id"),
        *[F.when(seeded, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in _SEEDED],
        "feed_url",
        "last_fetched_at",
        "last_error",
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
        F.coalesce("created_at", run_at).alias("created_at"),
        F.when(~stored | (seeded & changed), run_at).otherwise(F.col("updated_at")).alias(
            "updated_at"
        ),
        action.alias("action"),
    )


def seed_counters(upserted: DataFrame) -> DataFrame:
    """One row: created, updated, skipped."""
    return upserted.agg(
        F.count_if(F.col("action") == "created").alias("created"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.lit(0).cast("long").alias("skipped"),
    )


def placeholder_sources(
    feed_urls: DataFrame, sources: DataFrame, run_at: Column, active: bool = False
) -> DataFrame:
    """Rows for feeds the catalogue does not know; inactive unless told otherwise.

    ``feed_urls`` has ``feed_url`` and optionally ``name``.
    """
    if "name" not in feed_urls.columns:
        feed_urls = feed_urls.withColumn("name", F.lit(None).cast("string"))
    wanted = feed_urls.groupBy("feed_url").agg(F.min("name").alias("name"))
    unknown = wanted.join(sources.select("feed_url"), "feed_url", "left_anti")
    default_name = F.concat(F.lit("Unknown Source ("), F.col("feed_url"), F.lit(")"))
    return unknown.select(
        source_key(F.col("feed_url")).alias("id"),
        F.coalesce(F.nullif(F.col("name"), F.lit("")), default_name).alias("name"),
        F.col("feed_url").alias("url"),
        "feed_url",
        F.lit(C.DEFAULT_CREDIBILITY).alias("credibility_score"),
        F.lit(active).alias("is_active"),
        F.lit(None).cast("timestamp").alias("last_fetched_at"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(0).alias("error_count"),
        run_at.alias("created_at"),
        run_at.alias("updated_at"),
    )


def lookup_sources(sources: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Bulk point lookup; ``found`` is false for keys the catalogue lacks."""
    hits = sources.withColumn("_hit", F.lit(True))
    joined = wanted.join(hits, key, "left")
    return joined.withColumn("found", F.col("_hit").isNotNull()).drop("_hit")


def source_by_feed_url(sources: DataFrame, feed_url: str) -> DataFrame:
    return sources.filter(F.col("feed_url") == feed_url).limit(1)


def source_by_id(sources: DataFrame, source_id: int) -> DataFrame:
    return sources.filter(F.col("id") == source_id).limit(1)


def _moment(ts: Column, run_id: Column) -> Column:
    """Time and run id as one number: order by time, then id.

    A number of fixed width is aggregated by hashing, a struct only by sorting the
    whole log.
    """
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(19,0)")
    above_any_id = F.lit("10000000000000000000").cast("decimal(20,0)")
    return (micros * above_any_id + run_id.cast("decimal(20,0)")).cast("decimal(38,0)")


def source_health(runs: DataFrame) -> DataFrame:
    """Health per source after a log of runs.

    ``runs``: source_id, run_id, ts, ok, error. Errors count since the last
    success. Both passes aggregate on the map side and the join between them is
    salted, so a source with a third of all runs never meets in one task.
    """
    runs = runs.withColumn("moment", _moment(F.col("ts"), F.col("run_id")))
    last_ok = runs.groupBy("source_id").agg(
        F.max(F.when(F.col("ok"), F.col("moment"))).alias("last_ok"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_fetched_at"),
    )
    is_open = ~F.col("ok") & (
        F.col("last_ok").isNull() | (F.col("moment") > F.col("last_ok"))
    )
    failed = (
        join_one_per_key(
            runs.filter(~F.col("ok")), last_ok.drop("last_fetched_at"), ["source_id"], "run_id"
        )
        .filter(is_open)
        .groupBy("source_id")
        .agg(
            F.count(F.lit(1)).alias("error_count"),
            F.max(F.struct("moment", "error")).alias("last_failure"),
        )
    )
    return last_ok.join(failed, "source_id", "left").select(
        "source_id",
        "last_fetched_at",
        F.coalesce("error_count", F.lit(0)).cast("long").alias("error_count"),
        F.substring(F.col("last_failure.error"), 1, C.ERROR_MAX_LEN).alias("last_error"),
    )


def apply_health(sources: DataFrame, health: DataFrame, run_at: Column) -> DataFrame:
    """Fold a batch of run outcomes into the catalogue.

    A success in the batch resets the stored count; otherwise new failures add
    to it. Sources without runs are unchanged.
    """
    health = health.select(
        F.col("source_id").alias("id"),
        F.col("last_fetched_at").alias("new_fetched_at"),
        F.col("error_count").alias("new_errors"),
        F.col("last_error").alias("new_error"),
        F.lit(True).alias("ran"),
    )
    ran, success = F.col("ran").isNotNull(), F.col("new_fetched_at").isNotNull()
    return (
        sources.join(health, "id", "left")
        .withColumns(
            {
                "error_count": F.when(~ran, F.col("error_count"))
                .when(success, F.col("new_errors"))
                .otherwise(F.coalesce("error_count", F.lit(0)) + F.col("new_errors"))
                .cast("int"),
                "last_error": F.when(ran, F.col("new_error")).otherwise(F.col("last_error")),
                "last_fetched_at": F.coalesce("new_fetched_at", "last_fetched_at"),
                "updated_at": F.when(ran, run_at).otherwise(F.col("updated_at")),
            }
        )
        .drop("new_fetched_at", "new_errors", "new_error", "ran")
    )


def auto_deactivate(sources: DataFrame, after: int) -> DataFrame:
    """Switch off sources with ``after`` or more consecutive failures (0: never)."""
    if after <= 0:
        return sources
    return sources.withColumn(
        "is_active", F.col("is_active") & (F.coalesce("error_count", F.lit(0)) < after)
    )


def fair_sources(
    sources: DataFrame, as_of: Column, settings: C.BatchSettings = C.BatchSettings()
) -> DataFrame:
    """The next sources to fetch: active, not fetched just now, longest waiting first."""
    due = F.col("last_fetched_at").isNull() | (
        F.col("last_fetched_at")
        <= as_of - F.make_dt_interval(secs=F.lit(settings.min_fetch_interval_sec))
    )
    return (
        sources.filter(F.col("is_active") & due)
        .orderBy(F.col("last_fetched_at").asc_nulls_first(), F.col("id").asc())
        .limit(settings.source_limit)
    )


def batch_summary(runs: DataFrame) -> DataFrame:
    """Per-source lines and, with a null source_id, the total of the run.

    ``runs``: source_id, ok, inserted, skipped, errors, duration_ms. Rows are
    folded per source before the rollup doubles them.
    """
    sums = ("inserted", "skipped", "errors", "duration_ms")
    per_source = runs.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(~F.col("ok")).alias("failed_runs"),
        *[F.sum(c).alias(c) for c in sums],
    )
    return (
        per_source.rollup("source_id")
        .agg(
            F.count(F.lit(1)).alias("sources_total"),
            F.count_if(F.col("failed_runs") == 0).alias("sources_succeeded"),
            F.count_if(F.col("failed_runs") > 0).alias("sources_failed"),
            F.sum("runs").alias("runs"),
            *[F.sum(c).alias(c) for c in sums],
        )
    )
