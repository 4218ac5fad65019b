"""A training corpus from ``documents``: five stages, each on what the one before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as
Parquet to the shared folder and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``; the last adds mix_pass and order_key.

Null texts count as empty throughout. Rows without an id pass the near-duplicate stage
unjudged. An empty table comes out empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import decontaminate as leaks
from feedlake.llm import lines, mixing, simhash
from feedlake.llm import quality as classifier
from feedlake.llm.textrules import fold
from feedlake.session import materialize

QUALITY_THRESHOLD = 0.3
#: Weights reach this share of the greatest entropy, with no source read more often.
MIX = mixing.Target(entropy=0.95, repeats=4.0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, trained on the labelled ones, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = classifier.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return classifier.keep_good(docs, weights, QUALITY_THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are like an earlier one."""
    return lines.drop_later_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link: the one with the least id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return leaks.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per document and pass; sort by order_key, doc_id to read it."""
    return mixing.mixed(docs, MIX)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: The network and the fingerprints have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
