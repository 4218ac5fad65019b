"""Idempotent writes on plain Parquet tables.

A table is a folder of run folders (``run=<id>``) for appends, or of snapshot
folders (``snapshot=<n>``) plus a pointer for upserts. A job that is retried,
by Spark or by hand, overwrites its own run folder and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.operators.dedup import first_wins, run_counters
from feedlake.operators.validation import accepted, rejected, validate_articles
from feedlake.session import scratch_path
from feedlake.sinks.index import HashIndex


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def _drop_stage(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def read_runs(
    spark: SparkSession, path: str, schema: T.StructType, before: str | None = None
) -> DataFrame:
    """All rows of a run table, or those of runs sorting before ``before``."""
    full = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    table = spark.read.schema(full).parquet(path)
    if before is not None:
        table = table.filter(F.col("run") < before)
    return table


def write_run(rows: DataFrame, path: str, run: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def article_index(spark: SparkSession, table: str) -> HashIndex:
    return HashIndex(spark, f"{table}/index", f"{table}/articles")


def load_articles(
    batch: DataFrame, table: str, run: str, order: list[str], feed: str = "source_id"
) -> DataFrame:
    """Validate, deduplicate and append one batch; returns its counters per feed.

    The batch is cleaned once and staged in the shared folder, because four
    readers need it. The table below ``table`` has articles/, quarantine/, counters/
    and index/, the hashes of all runs: a load reads the part of the index that its
    own hashes fall on, never the articles of earlier runs. ``run`` must sort after all
    earlier runs; running it again replaces its output and leaves the same table.
    """
    spark = batch.sparkSession
    staged_path = scratch_path(spark, "stage")
    validate_articles(batch).write.parquet(staged_path)
    staged = spark.read.parquet(staged_path)
    good = accepted(staged).drop("link_scheme_ok")

    index = article_index(spark, table)
    # Three readers follow; a batch's known hashes are no more than the batch.
    known_path = scratch_path(spark, "known")
    index.stored(good, run).write.parquet(known_path)
    known = spark.read.parquet(known_path)
    fresh = first_wins(good, "content_hash", order).join(known, "content_hash", "left_anti")
    write_run(rejected(staged), f"{table}/quarantine", run)
    counters = run_counters(staged, known, feed, order[0])
    write_run(counters, f"{table}/counters", run)
    write_run(fresh.select(*good.columns), f"{table}/articles", run)
    index.add(run)
    _drop_stage(spark, staged_path)
    _drop_stage(spark, known_path)
    return spark.read.parquet(f"{table}/counters/run={run}")


def _pointer(path: str) -> str:
    return f"{path}/current"


def current_snapshot(spark: SparkSession, path: str) -> int | None:
    """Number of the snapshot readers should use; None for a new table."""
    if not _exists(spark, _pointer(path)):
        return None
    return spark.read.json(_pointer(path)).agg(F.max("snapshot")).first()[0]


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    number = current_snapshot(spark, path)
    if number is None:
        raise FileNotFoundError(f"no snapshot below {path}")
    return spark.read.parquet(f"{path}/snapshot={number}")


def write_snapshot(rows: DataFrame, path: str) -> int:
    """Write the next snapshot, then move the pointer.

    The snapshot being read is never overwritten: a crash before the pointer
    moves leaves the old table in place. Pointers are appended, the highest wins.
    """
    spark = rows.sparkSession
    current = current_snapshot(spark, path)
    number = 0 if current is None else current + 1
    rows.write.mode("overwrite").parquet(f"{path}/snapshot={number}")
    spark.range(1).select(F.lit(number).alias("snapshot")).write.mode("append").json(_pointer(path))
    return number
