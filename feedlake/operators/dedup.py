"""Deduplication, insert-if-absent and load counters.

One hash may hold a third of all rows. Every step below therefore reduces rows
per key on the map side before it shuffles, or joins against one row per key, a
shape adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row per key.

    ``order`` must be total. Spark turns rank <= 1 into a per-task limit ahead
    of the shuffle, so a task ships at most one row per key.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")
    )


def duplicate_groups(rows: DataFrame, key: str, row_id: str, source: str) -> DataFrame:
    """Keys held by several rows: how many rows, the first one, how many sources."""
    per_source = rows.groupBy(key, source).agg(
        F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_id")
    )
    return (
        per_source.groupBy(key)
        .agg(
            F.sum("n").alias("copies"),
            F.min("first_id").alias("first_id"),
            F.count(F.lit(1)).alias("sources"),
        )
        .filter("copies > 1")
    )


def unique_key_violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; a null never equals a null."""
    present = rows
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def new_articles(
    batch: DataFrame, existing: DataFrame, order: Sequence[str | Column], key: str = "content_hash"
) -> DataFrame:
    """Rows to insert: first of their hash in the batch and absent from the table.

    The window and the anti join use the same key, so the batch is shuffled
    once; of the table only the hash column is read.
    """
    return first_wins(batch, key, order).join(existing.select(key), key, "left_anti")


def stored_hashes(batch: DataFrame, existing: DataFrame, key: str = "content_hash") -> DataFrame:
    """Hashes of a batch that the table already holds.

    For a *materialised* small batch against a large table: Spark sends the
    batch's hashes to the table's scan when they fit its broadcast limit, so the
    table is not shuffled, and shuffles both when they do not.
    """
    return existing.select(key).join(batch.select(key), key, "left_semi").distinct()


def run_counters(
    rows: DataFrame, existing: DataFrame, feed: str, order: str, key: str = "content_hash"
) -> DataFrame:
    """Parsed, inserted, skipped and errors per feed.

    ``rows`` carry ``violations`` and an ``order`` number unique per row. Copies
    are counted per (feed, hash) first, so a hot hash shrinks before any join.
    """
    per_hash = (
        rows.select(feed, key, order, (F.size("violations") > 0).alias("is_error"))
        .groupBy(feed, key, "is_error")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_order"))
    )
    stored = existing.select(key).distinct().withColumn("stored", F.lit(True))
    candidate = F.when(~F.col("is_error") & F.col("stored").isNull(), F.col("first_order"))
    return (
        per_hash.join(stored, key, "left")
        .withColumn("candidate", candidate)
        # At most two rows per feed and hash reach this window.
        .withColumn("winner", F.min("candidate").over(Window.partitionBy(key)))
        .groupBy(feed)
        .agg(
            F.sum("n").alias("parsed"),
            F.count_if(F.col("candidate") == F.col("winner")).alias("inserted"),
            F.sum(F.when(F.col("is_error"), F.col("n")).otherwise(0)).alias("errors"),
        )
        .withColumn("skipped", F.col("parsed") - F.col("inserted") - F.col("errors"))
        .select(feed, "parsed", "inserted", "skipped", "errors")
    )


def fk_orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Key values of a child table that the parent lacks, with their row counts.

    Counting per value comes first: the join then sees each value once.
    """
    referenced = (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("missing_key"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    parents = parent.select(F.col(parent_key).alias("missing_key"))
    return referenced.join(parents, "missing_key", "left_anti")


def audit_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Every foreign-key orphan and unique-key clash of the article tables."""
    from feedlake import schemas

    reports = [
        fk_orphans(tables[fk.child], fk.column, tables[fk.parent], "id").select(
            F.lit(f"{fk.child}.{fk.column}").alias("constraint"),
            F.col("missing_key").cast("string").alias("key"),
            "n_rows",
        )
        for fk in schemas.FOREIGN_KEYS
        if fk.child in tables and fk.parent in tables
    ] + [
        unique_key_violations(tables[table], keys).select(
            F.lit(f"{table}({','.join(keys)})").alias("constraint"),
            F.concat_ws("|", *keys).alias("key"),
            "n_rows",
        )
        for table, keys in schemas.UNIQUE_KEYS
        if table in tables
    ]
    result = reports[0]
    for report in reports[1:]:
        result = result.unionByName(report)
    return result
