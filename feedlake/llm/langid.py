"""Language identification by multilingual mixture inference.

A text is taken as a mixture of the learned languages. Expectation-maximisation
finds the proportions that make its n-grams likeliest; languages are then taken out,
least proportion first, and the set with the best penalised likelihood is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
ORDERS = (2, 3, 4)
#: Learned languages times buckets is what the tasks get; more than these fail.
MAX_LANGUAGES = 512
ROUNDS = 12
#: Price of one more language, in units of log(number of n-grams).
PENALTY = 3.0
#: n-grams that are counted at once.
STEP = 1 << 20
UNDETERMINED = "und"

#: Bytes of lower-cased text: ASCII letters and non-ASCII stay, the rest is space.
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the byte n-grams of a whole text, those of spaces left out."""
    words = b" ".join((text or "").lower().encode().translate(_LETTERS).split())
    total = np.zeros(BUCKETS, np.int64)
    overlap = max(ORDERS) - 1
    for start in range(0, len(words), STEP):
        data = np.frombuffer(b" " + words[max(0, start - overlap) : start + STEP] + b" ", np.uint8)
        data = data[1:] if start else data
        data = data if start + STEP >= len(words) else data[:-1]
        data = data.astype(np.uint32)
        for order in ORDERS:
            # n-grams that end in the overlap belong to the block before.
            skip = overlap - order + 1 if start else 0
            count = len(data) - order + 1
            if count <= skip:
                continue
            code = np.full(count - skip, order, np.uint32)
            for i in range(order):
                code = code * np.uint32(0x01000193) ^ data[skip + i : count + i]
            code *= np.uint32(0x9E3779B1)
            total += np.bincount(code >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    """Languages in order, and the log probability of each bucket under each."""

    languages: list[str]
    logs: np.ndarray


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """n-gram counts by language over every row with a text and a language.

    Tasks count their own rows; counts are summed by language and bucket. What comes
    to the driver has at most languages x buckets numbers.
    """
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("text is not null and lang is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                found, counts = grams(text)
                if lang not in held:
                    if len(held) >= MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang][found] += counts
        for lang, counts in held.items():
            found = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": found, "n": counts[found]})

    counted = known.mapInPandas(count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), BUCKETS))
    counts[rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), rows["bucket"]] = rows["n"]
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    return Model(languages, logs.astype(np.float32))


def mixture(likely: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``likely`` (languages x n-grams), and their log likelihood."""
    share = np.full(len(likely), 1 / len(likely))
    if len(likely) > 1:
        weight = counts / counts.sum()
        for _ in range(ROUNDS):
            share = share * (likely @ (weight / (share @ likely)))
            share /= share.sum()
    return share, float(counts @ np.log(share @ likely))


def proportions(model: Model, text: str | None) -> tuple[list[tuple[str, float]], float]:
    """The chosen languages with their proportions, greatest first, and the share of
    the first among all learned languages. Nothing for a text without a letter."""
    if not model.languages or not any(map(str.isalpha, text or "")):
        return [], 0.0
    found, counts = grams(text)
    if not len(found):
        return [], 0.0
    logs = model.logs[:, found].astype(np.float64)
    top = logs.max(axis=0)
    likely = np.exp(logs - top)
    counts = counts.astype(np.float64)
    chosen = np.arange(len(logs))
    share, fit = mixture(likely, counts)
    everywhere = share
    price = PENALTY * np.log(max(counts.sum(), 2))
    best = (fit - price * len(chosen), chosen, share)
    while len(chosen) > 1:
        drop = 1 if len(chosen) <= 8 else len(chosen) // 2
        kept = np.sort(np.argsort(-share, kind="stable")[: len(chosen) - drop])
        chosen = chosen[kept]
        share, fit = mixture(likely[chosen], counts)
        # Later sets have fewer languages: on equal value the smaller one is taken.
        if fit - price * len(chosen) >= best[0]:
            best = (fit - price * len(chosen), chosen, share)
    _, chosen, share = best
    order = np.argsort(-share, kind="stable")
    named = [(model.languages[chosen[i]], float(share[i])) for i in order]
    return named, float(np.clip(everywhere[chosen[order[0]]], 0, 1))


def languages(model: Model, text: Column) -> Column:
    """Struct (lang, score, mixture) of a text column.

    ``mixture`` lists the languages and their proportions. Null, empty and letterless
    texts are ``und`` with score 0, as is everything if no language was learned.
    """
    @F.pandas_udf("lang string, score double, mixture array<struct<lang:string,share:double>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [proportions(model, t) for t in texts]
            yield pd.DataFrame(
                {
                    "lang": [named[0][0] if named else UNDETERMINED for named, _ in found],
                    "score": [score for _, score in found],
                    "mixture": [[{"lang": a, "share": b} for a, b in named] for named, _ in found],
                }
            )

    return of(text)
