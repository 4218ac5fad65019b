"""Session helpers: UTC rendering and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


@functools.cache
def _local_fallback() -> str:
    return tempfile.mkdtemp(prefix="feedlake-")


def pin_utc(spark: SparkSession) -> SparkSession:
    """All timestamps are UTC; pin the session so that rendering agrees."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A machine-local folder is made only where the setting is absent *and* the
    session runs in one process, as in tests.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    return _local_fallback()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/feedlake/{name}-{uuid.uuid4().hex}"


def materialize(rows: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result that several steps read, and read it back.

    It lives in the shared folder, so losing an executor loses nothing, and later
    steps plan with its real size. Clearing that folder is left to its owner.
    """
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def gathered(rows: DataFrame, key: str, pieces: int = 16) -> DataFrame:
    """All rows of a key in one partition, ``pieces`` partitions for each split of the scan.

    What is then counted per key needs no further shuffle: the texts move once, not the
    words made of them. Partitions grow in number with the input and not in size, so the
    state of a task does not grow; adaptive execution leaves them as they are.
    """
    spark = rows.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(max(least, pieces * rows.rdd.getNumPartitions()), key)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Use all cores for heavy per-row work on a scan with few splits.

    A file written as one row group is one task however large the cluster. Such
    a scan is hashed on a key first (hashing, unlike dealing rows out in turn,
    gives the same partitions when a lost task is run again). A scan with enough
    splits is returned as it is, so large tables are never shuffled for this.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() * 2 > cores:
        return rows
    return rows.repartition(cores, key)
