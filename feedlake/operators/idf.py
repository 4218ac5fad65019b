"""Frozen IDF tables: kept for a window of articles, and counted a day at a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.operators.ranking import idf_of, term_counts
from feedlake.sinks.index import partition_folders

_DAY = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("day", T.StringType())]
)


class IdfStore:
    """Document frequencies below ``path``: a folder per day and set of articles, and a
    folder per window with its IDF.

    A window is named by its bounds and an order-free hash of its article ids. While its
    table is younger than ``lifetime`` seconds it is read as it is. Otherwise the days'
    counts are summed; only a day whose articles are not counted yet has its texts read,
    so a window that moves on by a day reads that day. Articles are told apart by id: a
    text that changes under the same id is not seen before the store is cleared.
    """

    def __init__(self, spark: SparkSession, path: str, lifetime: float = 3600, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.lifetime, self.clock = spark, path, lifetime, clock

    def _days(self, window: DataFrame) -> dict[str, int]:
        """Name and number of articles of each day; the ids alone are read for it."""
        number = F.xxhash64("article_id")
        days = window.groupBy(F.to_date("published_at").cast("string").alias("d")).agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(number).alias("x"), F.sum(F.pmod(number, F.lit(2**31 - 1))).alias("s")
        )
        return {f"{r.d}_{r.n}_{r.x & (2**64 - 1):016x}_{r.s}": r.n for r in days.orderBy("d").collect()}

    def _count(self, window: DataFrame, names: list[str]) -> None:
        """Add the document frequencies of some days."""
        dates = {n.partition("_")[0]: n for n in names}
        day = F.to_date("published_at").cast("string")
        named = F.create_map(*(F.lit(x) for pair in dates.items() for x in pair))
        rows = window.where(day.isin(list(dates))).withColumn("day", named[day])
        of = rows.select("article_id", "day").distinct()
        counts = term_counts(rows).join(of, "article_id").groupBy("day", "term").agg(F.count(F.lit(1)).alias("df"))
        counts.write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(
            f"{self.path}/days"
        )

    def frozen(self, articles: DataFrame, start: Column, end: Column) -> DataFrame:
        """(term, idf) of the articles published from ``start`` to before ``end``."""
        window = articles.where((F.col("published_at") >= start) & (F.col("published_at") < end))
        days = self._days(window)
        name = self.spark.range(1).select(F.md5(F.concat_ws("|", start.cast("string"), end.cast("string"), F.lit(",".join(days))).cast("binary"))).first()[0]
        folder = f"{self.path}/idf/{name}"
        now = round(self.clock() * 1000)
        young = [m for m in partition_folders(self.spark, folder, "made") if 0 <= now - int(m) <= self.lifetime * 1000]
        if not young:
            missing = sorted(set(days) - set(partition_folders(self.spark, f"{self.path}/days", "day")))
            if missing:
                self._count(window, missing)
            if partition_folders(self.spark, f"{self.path}/days", "day"):
                rows = self.spark.read.schema(_DAY).parquet(f"{self.path}/days").where(F.col("day").isin(list(days)))
            else:
                rows = self.spark.createDataFrame([], _DAY)
            df = rows.groupBy("term").agg(F.sum("df").alias("df"))
            idf_of(df, sum(days.values())).write.mode("overwrite").parquet(f"{folder}/made={now}")
            young = [str(now)]
        return self.spark.read.schema("term string, idf double").parquet(f"{folder}/made={max(young, key=int)}")
