"""Benchmark passages in documents, found by Wu-Manber search over words.

Test strings are windows of consecutive words. A block is the last two words under
the search position: its shift says how far the search may jump without missing an
occurrence, a shift of zero names the bucket of test strings that end in the block,
and comparing those word by word confirms. In most text no block belongs to any
test string and the search moves nine words at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.textrules import alnum_words

WINDOW_WORDS = 10
BLOCK_WORDS = 2
#: Test strings are shipped to the tasks in slices of about this many bytes.
SLICE_BYTES = 32 << 20

RESULT = "n_words long, n_hit long, spans array<struct<start:long,stop:long>>, items array<string>"


def windows(text: str | None, size: int = WINDOW_WORDS) -> list[tuple[bytes, ...]]:
    """All windows of an item; a shorter item with words is one window."""
    words = alnum_words(text)
    if not words:
        return []
    size = min(size, len(words))
    return list(dict.fromkeys(zip(*(words[i:] for i in range(size)), strict=False)))


class Searcher:
    """Shift tables and buckets, one pair for each length of test strings."""

    def __init__(self, strings: dict[tuple[bytes, ...], list[str]]):
        self.tables = []
        by_length = defaultdict(list)
        for string in strings:
            by_length[len(string)].append(string)
        for length, group in by_length.items():
            block = min(BLOCK_WORDS, length)
            shifts: dict[tuple[bytes, ...], int] = {}
            buckets = defaultdict(list)
            for string in group:
                for stop in range(block, length + 1):
                    key = string[stop - block : stop]
                    shifts[key] = min(shifts.get(key, length), length - stop)
                buckets[string[length - block :]].append((string, strings[string]))
            self.tables.append((length, block, shifts, buckets))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, word after the last, items) of every occurrence."""
        count = len(words)
        for length, block, shifts, buckets in self.tables:
            furthest = length - block + 1
            at = length
            while at <= count:
                key = tuple(words[at - block : at])
                shift = shifts.get(key, furthest)
                if shift:
                    at += shift
                    continue
                for string, items in buckets[key]:
                    if tuple(words[at - length : at]) == string:
                        yield at - length, at, items
                at += 1


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word ranges, as ordered ranges that neither meet nor overlap."""
    spans: list[tuple[int, int]] = []
    for start, stop in sorted(found):
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], stop))
        else:
            spans.append((start, stop))
    return spans


def search(words: list[bytes], searcher: Searcher) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged, ordered spans of hit words, and the items they stem from."""
    found, items = [], set()
    for start, stop, ids in searcher.occurrences(words):
        found.append((start, stop))
        items.update(ids)
    return merged(found), items


def shipped_slices(
    benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW_WORDS
) -> list[Broadcast]:
    """The (window, item) pairs, measured first and then shipped in bounded slices.

    A slice holds the pairs of one hash range, so no window and no item, however
    frequent, makes a slice large.
    """
    spark = benchmark.sparkSession

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [b" ".join(w).decode() for w in windows(t, size)])

    pairs = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.explode(cut(F.col(text_col))).alias("window")
    ).where("item is not null")
    pairs = pairs.distinct()
    total = pairs.agg(F.sum(F.octet_length("window") + F.octet_length("item"))).first()[0] or 0
    count = -(-total // SLICE_BYTES) or 1
    shipped = []
    for k in range(count):
        part = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(count)) == k)
        shipped.append(spark.sparkContext.broadcast([tuple(r) for r in part.collect()]))
    return shipped


def _searcher(pairs: list[tuple[str, str]]) -> Searcher:
    strings = defaultdict(list)
    for item, window in pairs:
        strings[tuple(window.encode().split())].append(item)
    return Searcher(strings)


def hits(text: Column, shipped: list[Broadcast]) -> Column:
    """Struct (n_words, n_hit, spans, items) of a text column.

    spans are word positions, merged and ordered; items are sorted as strings. A
    null or word-less text has no words, no spans and no items.
    """

    @F.pandas_udf(RESULT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        last = None
        for texts in batches:
            split = texts.map(alnum_words)
            results = [([], set()) for _ in range(len(split))]
            for k, part in enumerate(shipped):
                if last is None or last[0] != k:
                    last = None  # one slice in memory at a time
                    last = (k, _searcher(part.value))
                for words, (spans, items) in zip(split, results, strict=True):
                    new_spans, new_items = search(words, last[1])
                    spans += new_spans
                    items |= new_items
            results = [(merged(spans), items) for spans, items in results]
            yield pd.DataFrame(
                {
                    "n_words": split.map(len).to_numpy(),
                    "n_hit": [sum(stop - start for start, stop in spans) for spans, _ in results],
                    "spans": [[{"start": a, "stop": b} for a, b in spans] for spans, _ in results],
                    "items": [sorted(items) for _, items in results],
                }
            )

    return found(text)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW_WORDS,
) -> DataFrame:
    """(id, n_words, n_hit, spans, items) per row of ``docs``, repeated rows included.

    Null texts have no words; items with a null id or no words are passed over; an
    empty benchmark hits nothing. Other columns of either table are not read. Only
    the benchmark is shipped, in slices of a checked size; documents are not shuffled.
    """
    shipped = shipped_slices(benchmark, item_col, item_text_col, size)
    found = hits(F.col(text_col), shipped)
    return docs.select(F.col(id_col).alias("id"), found.alias("found")).select("id", "found.*")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = WINDOW_WORDS
) -> DataFrame:
    """The rows of ``docs`` without any benchmark window; columns as they were."""
    shipped = shipped_slices(benchmark, size=size)
    return docs.where(hits(F.col(text_col), shipped)["n_hit"] == 0)


def items_digest(items: Column) -> Column:
    """SHA-256 of the comma-joined items."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
