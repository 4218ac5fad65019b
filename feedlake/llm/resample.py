"""Importance resampling: draw the documents whose n-grams are likest a target's.

Hashed n-gram counts of the corpus and of the target give every bucket a gain, the
logarithm of how much more of the target than of the corpus falls on it. A document
weighs the mean gain of its n-grams; a Gumbel variate from a hash of its id is added,
and the highest sums are drawn, which samples by weight without replacement.

N-grams are counted a batch at a time: texts are joined with a sentinel, one pass of
a regular expression finds all words and sentinels, ``searchsorted`` over the document
offsets tells which n-grams lie within one document, and ``bincount`` counts them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.textrules import ALNUM, byte_slices, free_name
from feedlake.session import materialize

NGRAM = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
_SENTINEL = b"\n"
#: What is no word byte is a space by now, so a line feed is only ever a sentinel.
_TOKEN = re.compile(rb"[^ \n]+|\n")


def ngram_buckets(texts: list[bytes], ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, text of each n-gram, bucket of each n-gram) of lower-cased texts.

    N-grams are all runs of 1 to ``ngram`` words of one text.
    """
    joined = _SENTINEL.join(t.translate(ALNUM) for t in texts)
    tokens = _TOKEN.findall(joined)
    crc = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
    # A sentinel is a token too: document k ends where the k-th of them stands.
    maybe = np.flatnonzero(crc == zlib.crc32(_SENTINEL))
    offsets = np.array([k for k in maybe if tokens[k] == _SENTINEL], np.int64)
    owner = np.searchsorted(offsets, np.arange(len(tokens)), "right")
    word = np.ones(len(tokens), bool)
    word[offsets] = False
    words = np.bincount(owner[word], minlength=len(texts))
    owners, hashed = [owner[word]], [crc[word] % buckets]
    run = crc.tolist() if ngram > 1 else []
    for size in range(2, ngram + 1):
        # A run is its shorter run, a space and the word behind; crc32 goes on from there.
        run = [zlib.crc32(b" " + t, c) for c, t in zip(run, tokens[size - 1 :], strict=False)]
        last = len(tokens) - size + 1
        if last < 1:
            break
        inside = word[:last] & (owner[:last] == owner[size - 1 :])
        owners.append(owner[:last][inside])
        hashed.append((np.array(run, np.uint32) % buckets)[inside])
    return words, np.concatenate(owners), np.concatenate(hashed).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """N-grams per bucket over all rows. Tasks count, Spark adds, and ``buckets`` rows at
    most come back, whatever the input."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, held in byte_slices(batch["text"].tolist()):
                total += np.bincount(ngram_buckets(held, ngram, buckets)[2], minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used.astype(np.int32), "n": total[used]})

    found = texts.select(F.col(text_col).alias("text")).mapInPandas(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the add-one shares of each bucket, rounded down."""
    size = float(len(corpus))
    s, t = float(corpus.sum()) + size, float(target.sum()) + size
    ratios = ((b + 1.0) * s / ((a + 1.0) * t) for a, b in zip(corpus.astype(float), target.astype(float), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weights(table: np.ndarray, text: Column, ngram: int = NGRAM) -> Column:
    """Struct (n_words, n_features, weight) of a text column; no n-grams weigh 0."""
    buckets = len(table)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = []
            for first, end, held in byte_slices(texts.tolist()):
                words, owner, bucket = ngram_buckets(held, ngram, buckets)
                n = np.bincount(owner, minlength=end - first)
                # Sums of whole numbers are exact in doubles up to 2^53.
                total = np.bincount(owner, table[bucket], minlength=end - first).astype(np.int64)
                parts.append((words, n, np.where(n > 0, total // np.maximum(n, 1), 0)))
            columns = map(np.concatenate, zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
            yield pd.DataFrame(dict(zip(("n_words", "n_features", "weight"), columns, strict=True)))

    return weigh(text)


def noise(key: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel variate that a row's key fixes, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` (id, score, ...) with rank: 1, 2, ... for the highest ``percent`` in a
    hundred of the eligible rows, equal scores by id; null for all others.

    Scores are whole thousandths, so they are few: rows are counted by score, running
    counts tell where each score's rows start, and only rows of one score are ordered
    together. The noise spreads equal weights over thousands of scores.
    """
    count = scored.where(eligible).count()
    wanted = percent * count // 100
    per_score = scored.where(eligible).groupBy("score").agg(F.count("*").alias("rows"))
    above = F.sum("rows").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    starts = per_score.select("score", F.coalesce(above, F.lit(0)).alias("before")).where(F.col("before") < wanted)
    starts = materialize(starts, "starts")
    least = starts.agg(F.min("score")).first()[0]
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = F.coalesce(eligible & (F.col("score") >= least), F.lit(False))
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("id")))
    place = F.col("before") + within
    drawn = scored.where(high).join(starts, "score").withColumn("rank", F.when(place <= wanted, place)).drop("before")
    return drawn.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank), a row per row of ``docs``.

    Null and empty texts have no n-grams and weight 0; texts of any length are read
    whole. A null id counts as empty text in the noise and comes last among equal
    scores; rows that repeat an id are rows of their own, with the same noise. Ties go
    to the smaller id. An empty target weighs all buckets by the corpus alone; an empty
    corpus gives an empty result. No other column of either table is read.
    """
    table = gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, target_text_col, ngram, buckets))
    rows = docs.select(F.col(id_col).alias("id"), weights(table, F.col(text_col), ngram).alias("w")).select("id", "w.*")
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    scored = materialize(rows.withColumn("score", F.col("weight") + noise(key, seed)), "weights")
    return ranked(scored, F.col("n_words") >= min_words, percent)


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, columns as they were."""
    kept = resample(docs, target, **options).where("rank is not null")
    name = free_name(docs, "drawn_id")
    ids = kept.select(F.col("id").alias(name)).distinct()
    return docs.join(ids, F.col(options.get("id_col", "doc_id")).eqNullSafe(F.col(name)), "left_semi")
