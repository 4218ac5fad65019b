"""Index of an article table's hashes, so that a load reads a bounded part of history.

Runs add their hashes as small folders. Compaction merges them into a snapshot that is
partitioned by the first hexadecimal digits of the hash and sorted within a partition,
with Parquet Bloom filters. A lookup reads the partitions that its batch touches and
the runs since the last compaction; all else is pruned before anything is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "content_hash"
#: Rows of a partition after compaction, about; more hashes get more digits.
PARTITION_ROWS = 200_000
#: A batch's prefixes come to the driver, 16 to this power at most.
MOST_DIGITS = 4

_ROW = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("run", T.StringType())])
_BASE = T.StructType([*_ROW.fields, T.StructField("prefix", T.StringType())])


def partition_folders(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the partition folders ``column=`` below ``path``."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(hadoop_path)]
    return sorted(n.partition("=")[2] for n in names if n.startswith(f"{column}="))


class HashIndex:
    """The index below ``path`` of the article runs below ``articles``."""

    def __init__(self, spark: SparkSession, path: str, articles: str):
        self.spark, self.path, self.articles = spark, path, articles

    def _state(self) -> tuple[int, int, str] | None:
        """(snapshot, digits, last run in it); None before the first compaction. States
        are appended and the highest number counts, so a crash leaves the old one."""
        if not partition_folders(self.spark, f"{self.path}/state", "snapshot"):
            return None
        rows = self.spark.read.schema("digits int, through string, snapshot int").json(f"{self.path}/state")
        last = rows.agg(F.max(F.struct("snapshot", "digits", "through")).alias("s")).first().s
        return last.snapshot, last.digits, last.through

    def _runs(self) -> DataFrame:
        """Hashes of runs since the last compaction."""
        state = self._state()
        if not partition_folders(self.spark, f"{self.path}/runs", "run"):
            return self.spark.createDataFrame([], _ROW)
        rows = self.spark.read.schema(_ROW).parquet(f"{self.path}/runs")
        return rows if state is None else rows.where(F.col("run") > state[2])

    def add(self, run: str) -> None:
        """Index the articles of a run; again replaces what was there."""
        rows = self.spark.read.schema(T.StructType([_ROW.fields[0]])).parquet(f"{self.articles}/run={run}")
        rows.sort(KEY).write.mode("overwrite").parquet(f"{self.path}/runs/run={run}")

    def repair(self, before: str) -> list[str]:
        """Index runs that an earlier job wrote without coming to its index; their names."""
        state = self._state()
        known = set(partition_folders(self.spark, f"{self.path}/runs", "run"))
        through = "" if state is None else state[2]
        missing = [r for r in partition_folders(self.spark, self.articles, "run") if through < r < before and r not in known]
        for run in missing:
            self.add(run)
        return missing

    def candidates(self, batch: DataFrame, before: str) -> DataFrame:
        """(content_hash, run): the part of the index that may hold a batch's hashes, of
        runs ahead of ``before``."""
        rows = self._runs()
        state = self._state()
        if state is not None:
            snapshot, digits, _ = state
            touched = batch.select(F.substring(KEY, 1, digits).alias("p")).where("p is not null").distinct()
            base = self.spark.read.schema(_BASE).parquet(f"{self.path}/base/snapshot={snapshot}")
            base = base.where(F.col("prefix").isin([r.p for r in touched.collect()]))
            rows = rows.unionByName(base.select(KEY, "run"))
        return rows.where(F.col("run") < before)

    def stored(self, batch: DataFrame, before: str) -> DataFrame:
        """Distinct hashes of a materialised ``batch`` that runs ahead of ``before`` hold."""
        self.repair(before)
        found = self.candidates(batch, before)
        return found.join(batch.select(KEY), KEY, "left_semi").select(KEY).distinct()

    def compact(self) -> int:
        """Merge snapshot and runs into the next snapshot; its number.

        A hash keeps its earliest run, so a lookup for a run that is done again still
        leaves out that run's own hashes. Old snapshots and run folders are not read any
        more; clearing them is left to the table's owner.
        """
        self.repair("\U0010ffff")
        state, rows = self._state(), self._runs()
        if state is not None:
            base = self.spark.read.schema(_BASE).parquet(f"{self.path}/base/snapshot={state[0]}")
            rows = rows.unionByName(base.select(KEY, "run"))
        rows = rows.groupBy(KEY).agg(F.min("run").alias("run"))
        counted = rows.agg(F.count("*").alias("n"), F.max("run").alias("last")).first()
        digits = 1
        while digits < MOST_DIGITS and counted.n > PARTITION_ROWS * 16**digits:
            digits += 1
        names = partition_folders(self.spark, f"{self.path}/runs", "run")
        through = max([*names, *([state[2]] if state else [])], default="")
        number = 0 if state is None else state[0] + 1
        (
            rows.withColumn("prefix", F.substring(KEY, 1, digits))
            .repartition("prefix")
            .sortWithinPartitions("prefix", KEY)
            .write.partitionBy("prefix")
            .option(f"parquet.bloom.filter.enabled#{KEY}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{KEY}", str(PARTITION_ROWS))
            .mode("overwrite")
            .parquet(f"{self.path}/base/snapshot={number}")
        )
        told = self.spark.range(1).select(F.lit(digits).alias("digits"), F.lit(through).alias("through"))
        told.write.mode("overwrite").json(f"{self.path}/state/snapshot={number}")
        return number
