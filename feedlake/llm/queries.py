"""The numbered queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import sqltext
from feedlake.llm.textrules import fold

#: Weights reach this share of the greatest entropy, with no source read more often.
MIX_ENTROPY, MIX_REPEATS = sqltext.MIX_ENTROPY, sqltext.MIX_REPEATS

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import quality

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    scored = docs.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        quality.scorer(weights, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import simhash

    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        simhash.hex_digits(F.col("simhash")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import maxent

    docs = _table(spark, sf_dir, "documents")
    found = maxent.scores(docs, fold(F.col("doc_id"), 7) == 2)
    return found.withColumnRenamed("id", "doc_id")


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import extract

    pages = _table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", extract.texts(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import decontaminate

    benchmark = _table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), benchmark)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import lines

    found = lines.similar_lines(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "line", "first_id", "first_line", "n_links", "match_id", "match_line", "removed"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import mixing

    target = mixing.Target(entropy=MIX_ENTROPY, repeats=MIX_REPEATS)
    found = mixing.mix(_table(spark, sf_dir, "documents"), target)
    return found.withColumnRenamed("id", "doc_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import langid

    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = docs.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        langid.languages(model, F.col("text")).alias("found"),
    )
    return found.select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.mixture"
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import ordermin

    return ordermin.edit_report(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import repeats

    return repeats.report(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import resample

    found = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import search

    found = search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm import warc

    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def queries() -> dict[str, Query]:
    return {name: fn for name, fn in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(sqltext.SQL)
