"""SimHash near-duplicates, linked through covering locality-sensitive hashing.

A covering family (Pagh, 2016) gives every bit position a vector of radius + 1
bits; a mask per non-zero vector v keeps the positions whose vector has odd inner
product with v. Positions where two fingerprints differ number at most the radius,
so some v is orthogonal to all of them: the pair agrees under that mask. Nothing is
left to chance, and for radius 2 seven tables do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.components import connected_components
from feedlake.llm.textrules import free_name, space_words
from feedlake.session import materialize

BITS = 64
SEED = 42
#: Pairs are compared one by one in buckets up to this size; larger ones are
#: linked through shared neighbours, which is as exact and linear in their size.
PAIRWISE_BUCKET = 64
_STEP = 1 << 16
_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1


def simhash(text: str | None, shingle_words: int = 3) -> int:
    """The unsigned 64-bit fingerprint; 0 for a text without words."""
    words = space_words(text)
    if not words:
        return 0
    size = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    count = len(words) - size + 1
    ones = np.zeros((8, 8), np.int64)
    for start in range(0, count, _STEP):
        part = min(_STEP, count - start)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(part)), np.uint64, part)
        octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        histogram = np.bincount((octets + np.arange(8) * 256).ravel(), minlength=2048)
        ones += histogram.reshape(8, 256) @ _BYTE_BITS
    set_bits = (2 * ones > count).ravel()
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3
) -> DataFrame:
    """(id, simhash long) per row; the long holds the 64 bits, sign included."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.fromiter((simhash(t, shingle_words) for t in texts), np.uint64, len(texts))
            yield pd.Series(values.view(np.int64))

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("simhash"))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks: any two words of ``bits`` bits at most ``radius`` apart
    agree under one of them. Position i gets the vector i mod 2^(radius+1)."""
    width = 1 << (radius + 1)
    masks = []
    for v in range(1, width):
        mask = sum(1 << i for i in range(bits) if ((i % width) & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return masks


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect exactly what links at ``radius`` (0 to 2) connect.

    ``prints`` has one distinct ``simhash`` per row. Small buckets give their pairs
    within the radius. Members of larger buckets (a crowd of near copies) emit
    themselves and their 64 one-bit neighbours: two that are 1 or 2 apart meet at a
    shared value, and all that meet at one value are within 2 of each other, so a
    star per value links them.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    if radius == 0:
        return prints.select(F.col("simhash").alias("a"), F.col("simhash").alias("b")).where("false")
    keys = F.array(
        *(
            F.struct(F.lit(t).alias("t"), F.col("simhash").bitwiseAND(F.lit(mask)).alias("key"))
            for t, mask in enumerate(covering_masks(radius))
        )
    )
    rows = prints.select("simhash", F.explode(keys).alias("k")).select("simhash", "k.t", "k.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(rows.join(sizes, ["t", "key"]), "buckets")
    cool = rows.where(F.col("n") <= PAIRWISE_BUCKET)
    left = cool.select("t", "key", F.col("simhash").alias("a"))
    right = cool.select("t", "key", F.col("simhash").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & (apart <= radius))

    hot = rows.where(F.col("n") > PAIRWISE_BUCKET).select("simhash").distinct()
    flips = F.array(
        *(F.col("simhash").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(BITS))
    )
    if radius == 1:
        near = hot.select(F.col("simhash").alias("a"), F.explode(flips).alias("b"))
        stars = near.join(hot.select(F.col("simhash").alias("b")), "b").where("a < b")
    else:
        around = F.explode(F.concat(F.array("simhash"), flips)).alias("v")
        near = hot.select(F.col("simhash").alias("b"), around)
        least = near.groupBy("v").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
        stars = near.join(least, "v").where("a <> b")
    return pairs.select("a", "b").unionByName(stars.select("a", "b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    radius: int = 2,
) -> DataFrame:
    """(id, simhash, component) per row of ``docs``; component is the least id that
    links reach, its own included.

    A null text and one without words have fingerprint 0, which links like any
    other. Repeated rows and exact copies share a fingerprint and are compared once.
    A row whose id is null takes part, but names a component only if no row of it
    has an id. Other columns are not read. An empty table gives an empty one.
    """
    staged = materialize(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    prints = staged.groupBy("simhash").agg(F.min("id").alias("first_id"))
    roots = connected_components(links(prints.select("simhash"), radius))
    placed = prints.join(roots, prints["simhash"] == roots["node"], "left")
    placed = placed.select("simhash", "first_id", F.coalesce("root", "simhash").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component"))
    labels = placed.join(least, "root").select("simhash", "component")
    return staged.join(labels, "simhash").select("id", "simhash", "component")


def hex_digits(fingerprint: Column) -> Column:
    """The 64 bits as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    radius: int = 2,
) -> DataFrame:
    """``docs`` with one row of each component: the one with the least id, once even
    if its row is repeated. Rows without an id stay as they are."""
    found = near_duplicates(docs, id_col, text_col, shingle_words, radius)
    rows = found.groupBy("id", "component").agg(F.count("*").alias("n"))
    name = free_name(docs, "judged_id")
    # Most rows stay as they are, so it is the others' ids that the documents meet.
    judged = rows.where("id <> component or n > 1").select(
        F.col("id").alias(name), (F.col("id") == F.col("component")).alias("stays")
    )
    judged = materialize(judged, "judged")
    same = F.col(id_col) == F.col(name)
    single = docs.join(judged.select(name), same, "left_anti")
    repeated = docs.join(judged.where("stays").select(name), same, "left_semi").dropDuplicates([id_col])
    return single.unionByName(repeated)
