"""A bitmap of 64-bit keys, built by the tasks, that tells which rows may be wanted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: log2 of the greatest size in bits. With more keys than it can tell apart the
#: bitmap lets more rows through, never fewer.
MOST_BITS = 27


def key_filter(keys: DataFrame, column: str) -> Broadcast:
    """Ship a bitmap of at most 2^MOST_BITS bits that holds all keys of a long column.

    Keys are taken by their low bits, so they should be hashes. An empty table gives an
    empty bitmap."""
    count = keys.count()
    bits = 1 << min(MOST_BITS, max(16, (32 * count).bit_length()))
    part = min(bits, 1 << 20)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.zeros(bits, bool)
        for batch in batches:
            marks[batch[column].to_numpy() & (bits - 1)] = True
        for first in range(0, bits, part):
            if marks[first : first + part].any():
                yield pd.DataFrame({"first": [first], "marks": [np.packbits(marks[first : first + part]).tobytes()]})

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        marks = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in group["marks"]])
        return pd.DataFrame({"first": group["first"][:1], "marks": [marks.tobytes()]})

    table = np.zeros(bits, bool)
    marked = keys.select(column).mapInPandas(mark, "first int, marks binary")
    for row in marked.groupBy("first").applyInPandas(unite, "first int, marks binary").collect():
        table[row["first"] : row["first"] + part] = np.unpackbits(np.frombuffer(row.marks, np.uint8))[:part].astype(bool)
    return keys.sparkSession.sparkContext.broadcast(np.packbits(table))


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of some keys (64-bit integers) may be in the bitmap."""
    slots = keys.astype(np.int64) & (len(bitmap) * 8 - 1)
    return (bitmap[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)
