"""Table and source-list scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import schemas


def read_table(spark: SparkSession, location: str, name: str) -> DataFrame:
    """One of the article tables below ``location``, with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{location}/{name}")


def read_jdbc_table(
    spark: SparkSession, url: str, name: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """An article table of an external database, read in parallel id ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    reader = (
        reader.option("partitionColumn", "id")
        .option("lowerBound", str(lower))
        .option("upperBound", str(upper))
        .option("numPartitions", str(partitions))
    )
    return reader.options(**options).load()


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """Source lists: JSON files holding one array each. Malformed files fail."""
    return (
        spark.read.schema(schemas.SOURCE_LIST)
        .option("multiLine", "true")
        .option("mode", "FAILFAST")
        .json(path)
    )


def write_source_list(seeds: DataFrame, path: str, per_file: int = 1000) -> None:
    """Write seeds as JSON array files of at most ``per_file`` sources each.

    ``seeds`` has a dense integer ``seed_order`` next to the list's fields.
    """
    fields = [f.name for f in schemas.SOURCE_LIST.fields]
    lists = seeds.groupBy(F.floor(F.col("seed_order") / F.lit(per_file)).alias("file_no")).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("value")
    )
    lists.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
