"""The supplied tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions.tokens import words
from feedlake.functions.urls import url_host
from feedlake.session import gathered, spread

# Stand-ins for "now" and for publication times, which the tables lack.
RUN_DATE = "2024-01-31"
FIRST_DAY = "2024-01-01"
MINUTES = 43_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def run_date() -> Column:
    return F.lit(RUN_DATE).cast("timestamp")


def minutes_after_first_day(number: Column, step: int = 1) -> Column:
    """A time within thirty days, spread by a number column."""
    offset = F.make_dt_interval(mins=((number * step) % MINUTES).cast("int"))
    return F.lit(FIRST_DAY).cast("timestamp") + offset


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as feed entries: https pages carry an RFC-822 date, others none."""
    pages = pages_table(spark, sf_dir)
    stamp = F.concat(
        F.lit("Mon, "),
        F.date_format(minutes_after_first_day(F.col("page_id")), "dd MMM yyyy HH:mm:ss"),
        F.lit(" GMT"),
    )
    return pages.select(
        "page_id",
        F.col("page_id").alias("feed_order"),
        url_host(F.col("url")).alias("host"),
        F.lit(1).cast("long").alias("source_id"),
        F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.col("url").alias("link"),
        F.lit(None).cast("array<struct<rel:string,href:string>>").alias("links"),
        F.col("html").alias("summary"),
        F.lit(None).cast("string").alias("description"),
        F.regexp_extract("html", r'(?is)<meta name="author" content="([^"]*)"', 1).alias("author"),
        F.regexp_extract_all(
            "html", F.lit(r'<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1)
        ).alias("tags"),
        F.when(F.col("url").startswith("https"), stamp).alias("published"),
        F.lit(None).cast("string").alias("updated"),
    )


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as undated entries; copies of a text share their link."""
    docs = documents_table(spark, sf_dir)
    return docs.select(
        "doc_id",
        F.col("doc_id").alias("feed_order"),
        "source",
        F.substring_index("source", "src", -1).cast("long").alias("source_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(
            F.lit("https://news.example.com/"), F.substring(F.sha2("text", 256), 1, 16)
        ).alias("link"),
        F.lit(None).cast("array<struct<rel:string,href:string>>").alias("links"),
        F.lit("").alias("summary"),
        F.col("text").alias("description"),
        F.col("lang").alias("author"),
        F.array("lang", F.upper("lang"), "source").alias("tags"),
        F.lit("").alias("published"),
        F.lit(None).cast("string").alias("updated"),
    )


def ranked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dated articles of the last thirty days, each in one partition."""
    docs = gathered(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("article_id"),
        F.substring_index("source", "src", -1).cast("long").alias("source_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.regexp_replace("text", r"^[^\n]*\n?", "").alias("body"),
        minutes_after_first_day(F.col("doc_id"), 37).alias("published_at"),
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as topics: their words, and their first 2 to 5 as phrases."""
    tokens = words(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("topic_id"),
        F.array_distinct(
            F.concat(tokens, F.array(*(F.array_join(F.slice(tokens, 1, n), " ") for n in range(2, 6))))
        ).alias("keywords"),
    )


def credibility_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources; the balance scaled to 0..1 is the score."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://src"), F.col("s_suppkey"), F.lit(".example.com")).alias("url"),
        F.concat(F.lit("https://src"), F.col("s_suppkey"), F.lit(".example.com/feed")).alias(
            "feed_url"
        ),
        F.round((F.col("s_acctbal") + 1000) / 11000, 4).alias("credibility_score"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
    )


def fetch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a fetch log: an "error" event is a failed fetch of its user's feed."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"),
        F.col("event_id").alias("run_id"),
        "ts",
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("fetch failed: "), "props")).alias(
            "error"
        ),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback on documents: quality 1 is up, 0 is down."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("up"))
    docs = documents_table(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return docs.join(labels, "doc_id")


def text_stamp(moment: str) -> Column:
    """Timestamps leave the registered queries as text."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias(moment)
