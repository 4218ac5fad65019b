"""Byte strings that occur more than once, found from sampled suffixes.

A string is repeated if the same ``length`` bytes start anywhere else. Sorting or
merging every suffix of a corpus takes many times its size, so suffixes are sampled:
of the k-grams in each window of ``length`` bytes the one with the least hash is the
window's anchor. Equal windows have equal anchors at equal places, so the suffixes
that start at anchors (about one position in 85) stand for all windows, and classes of
suffixes are refined in three rounds. In each, tasks exchange keys and counts only, and
what is alone in its class leaves:

1. suffixes by the anchor's k-gram, then by their whole stretch, the bytes of all
   windows that have this anchor: where it recurs, every byte of it is repeated;
2. where one k-gram has different stretches (around an edit, or the edge of a repeated
   passage), by groups of up to 16 neighbouring windows, first by the bytes all of them
   share and then by all their bytes, one stretch of each kind against the others;
3. where one group of windows has different bytes, by the windows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.keyfilter import key_filter, may_hold
from feedlake.session import materialize

LENGTH = 200
GRAM = 32
#: Windows that are worked on at once; longer texts go block by block.
BLOCK = 1 << 20
#: log2 of the windows of a group in the second round.
GROUP_BITS = 4
_POSITION_BITS = 24
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(count, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, count.bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    up, down = _TABLES[size]
    return up[:count], down[:count]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class Block:
    """Hashes of any stretch of some bytes, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * up[:-1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray | slice, stops: np.ndarray | slice) -> np.ndarray:
        return _mixed((self.sums[stops] - self.sums[starts]) * self.down[starts])


def blocks(text: str | None, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of pieces that together hold every window once."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    for start in range(0, len(data) - length + 1, BLOCK):
        yield start, data[start : start + BLOCK + length - 1]


def anchors(block: Block, size: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(k-gram hash, stretch hash, first window, windows, place) of each anchor of a block."""
    grams = block.hashes(slice(0, size - gram + 1), slice(gram, size + 1))
    mask = _U((1 << _POSITION_BITS) - 1)
    # The place in the low bits makes the leftmost of equal k-grams the least.
    least = grams & ~mask | np.arange(len(grams), dtype=np.uint64)
    window, wide = length - gram + 1, 1
    while wide * 2 <= window:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if window > wide:
        least = np.minimum(least[: len(least) - (window - wide)], least[window - wide :])
    place = (least & mask).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    count = np.diff(first, append=len(place))
    at = place[first]
    stretch = block.hashes(first, first + count - 1 + length)
    shape = _mixed((at - first).astype(np.uint64) * _U(1 << 20) + count.astype(np.uint64))
    return grams[at], _mixed(stretch ^ shape), first, count, at


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with ``__key``, a hash of id and text: equal rows share it."""
    return docs.withColumn("__key", F.xxhash64(F.col(id_col).cast("string"), F.lit("|"), F.col(text_col)))


def suffixes(keyed: DataFrame, text_col: str, length: int, gram: int) -> DataFrame:
    """(key, gram, stretch, first, windows) of every anchor of every text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for key, text in zip(batch["key"], batch["text"], strict=True):
                for offset, data in blocks(text, length):
                    grams, stretches, first, count, _ = anchors(Block(data), len(data), length, gram)
                    held.append((np.full(len(first), key), grams, stretches, first + offset, count))
                    size += len(first)
                if size > 100_000:
                    yield _frame(held)
                    held, size = [], 0
            if held:
                yield _frame(held)

    def _frame(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        key, grams, stretches, first, count = (np.concatenate(x) for x in zip(*held, strict=True))
        return pd.DataFrame(
            {"key": key, "gram": grams.view(np.int64), "stretch": stretches.view(np.int64), "first": first, "windows": count}
        )

    rows = keyed.select(F.col("__key").alias("key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(cut, "key long, gram long, stretch long, first int, windows int")


def groups_of(block: Block, chosen: np.ndarray, found: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, ...]:
    """Groups of neighbouring windows of the chosen anchors: (shared bytes, all bytes,
    anchor, first window, windows). Groups are cut by distance from the anchor, so equal
    windows fall into equal groups; at the ends of a stretch a group may be partial, but
    what its windows share is taken as if it were whole."""
    _, _, first, count, place = found
    count = count[chosen]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    window = np.repeat(first[chosen], count) + step
    anchor = np.repeat(chosen, count)
    number = (place[anchor] - window) >> GROUP_BITS
    begins = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
    n = np.diff(begins, append=len(window))
    at, anchor, number = window[begins], anchor[begins], number[begins]
    last = place[anchor] - (number << GROUP_BITS)
    shared = block.hashes(last, last - (1 << GROUP_BITS) + 1 + length)
    whole = block.hashes(at, at + n - 1 + length)
    shape = _mixed((last - at).astype(np.uint64) * _U(1 << 20) + n.astype(np.uint64))
    return shared, _mixed(whole ^ shape), anchor, at, n


def _refined(
    keyed: DataFrame,
    text_col: str,
    grams: Broadcast,
    stretches: Broadcast,
    groups: Broadcast | None,
    length: int,
    gram: int,
) -> DataFrame:
    """Second round: (shared, bytes, stretch, at, n), the groups of windows of some
    stretches. Third, with ``groups``: (window, bytes, at), the windows of some groups.

    Filters hold the k-grams in question and, for stretches and groups, a kind together
    with one place that has it (stretch and key, bytes and stretch), so that the corpus
    gives each kind once, but for what the filters mistake.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for key, text in zip(batch["key"].to_numpy().view(np.uint64), batch["text"], strict=True):
                for _, data in blocks(text, length):
                    block = Block(data)
                    found = anchors(block, len(data), length, gram)
                    fresh = np.flatnonzero(may_hold(grams.value, found[0]))
                    fresh = fresh[may_hold(stretches.value, found[1][fresh] ^ key)]
                    if not len(fresh):
                        continue
                    shared, whole, anchor, at, n = groups_of(block, fresh, found, length)
                    if groups is None:
                        held.append((shared, whole, found[1][anchor], at - found[2][anchor], n))
                    else:
                        pick = np.flatnonzero(may_hold(groups.value, whole ^ found[1][anchor]))
                        n = n[pick]
                        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        start = np.repeat(at[pick], n) + step
                        held.append((block.hashes(start, start + length), np.repeat(whole[pick], n), step))
                    size += len(held[-1][0])
                if size > 200_000:
                    yield _frame(held)
                    held, size = [], 0
            if held:
                yield _frame(held)

    def _frame(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        return pd.DataFrame(
            {k: x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int32) for k, x in zip(names, columns, strict=True)}
        )

    names = ["shared", "bytes", "stretch", "at", "n"] if groups is None else ["window", "bytes", "at"]
    kinds = {"at": "int", "n": "int"}
    schema = ", ".join(f"{x} {kinds.get(x, 'long')}" for x in names)
    rows = keyed.select(F.col("__key").alias("key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(cut, schema)


def _runs(places: pd.Series) -> pd.Series:
    """Runs of consecutive numbers."""
    out = []
    for x in places:
        x = np.sort(np.asarray(x, np.int64))
        first = np.flatnonzero(np.diff(x, prepend=-2) != 1)
        out.append([{"first": int(x[a]), "windows": int(b - a)} for a, b in zip(first, [*first[1:], len(x)], strict=True)])
    return pd.Series(out)


def repeated_stretches(keyed: DataFrame, text_col: str, length: int, gram: int) -> DataFrame:
    """(key, first, windows): all windows that are repeated, as runs."""
    found = materialize(suffixes(keyed, text_col, length, gram), "suffixes")
    grams = found.groupBy("gram").agg(
        F.count("*").alias("n"), (F.min("stretch") != F.max("stretch")).alias("mixed")
    )
    grams = materialize(grams.where("n > 1").select("gram", "mixed"), "grams")
    alive = materialize(found.join(grams, "gram").select("key", "stretch", "first", "windows", "mixed"), "alive")
    mixed = alive.where("mixed")
    often = mixed.groupBy("stretch").agg(F.count("*").alias("n")).where("n > 1").select("stretch")
    whole = alive.where("not mixed").unionByName(mixed.join(often, "stretch", "left_semi").select(*alive.columns))

    chosen = mixed.groupBy("stretch").agg(F.min("key").alias("key"))
    chosen = materialize(chosen.select(F.col("stretch").bitwiseXOR(F.col("key")).alias("chosen")), "chosen")
    filters = key_filter(grams.where("mixed"), "gram"), key_filter(chosen, "chosen")
    groups = materialize(_refined(keyed, text_col, *filters, None, length, gram), "groups")
    several = (F.min("stretch") != F.max("stretch")).alias("several")
    repeated = groups.groupBy("bytes").agg(several).where("several").select("bytes")
    unlike = (F.min("bytes") != F.max("bytes")).alias("unlike")
    mixed_groups = groups.groupBy("shared").agg(unlike).where("unlike").select("shared")
    picked = groups.join(mixed_groups, "shared", "left_semi").groupBy("bytes").agg(F.min("stretch").alias("stretch"))
    picked = materialize(picked.select(F.col("bytes").bitwiseXOR(F.col("stretch")).alias("chosen")), "picked")
    windows = _refined(keyed, text_col, *filters, key_filter(picked, "chosen"), length, gram)
    windows = materialize(windows, "windows")
    # One shuffle by window serves the aggregate, which counts places to read what the join reads.
    # The filter (nothing is null) keeps the optimizer from putting one ahead of one reader only.
    dealt = windows.where("window is not null and bytes is not null").repartition("window")
    several_kinds = dealt.groupBy("window").agg(unlike, F.count("at").alias("places")).where("unlike and places > 1")
    places = dealt.join(several_kinds.select("window"), "window")
    in_runs = F.pandas_udf(_runs, "array<struct<first:int,windows:int>>")
    places = places.groupBy("bytes").agg(F.collect_set("at").alias("at")).select("bytes", in_runs("at").alias("runs"))
    found_runs = groups.join(repeated, "bytes", "left_semi").select("stretch", "at", F.lit(0).alias("f"), F.col("n").alias("w"))
    found_runs = found_runs.unionByName(
        groups.join(places, "bytes").select("stretch", "at", F.explode("runs").alias("r")).select(
            "stretch", "at", F.col("r.first").alias("f"), F.col("r.windows").alias("w")
        )
    )
    runs = found_runs.select("stretch", F.struct((F.col("at") + F.col("f")).alias("first"), F.col("w").alias("windows")).alias("run"))
    runs = runs.distinct()
    edges = mixed.select("key", "stretch", F.col("first").alias("start")).join(runs, "stretch")
    return whole.select("key", "first", "windows").unionByName(
        edges.select("key", (F.col("start") + F.col("run.first")).alias("first"), F.col("run.windows").alias("windows"))
    )


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """``docs`` with ``spans``: byte ranges (start, stop) covered by repeated strings,
    merged and in order; null for a text without any.

    Texts are UTF-8 bytes, a null text none; a match never spans two rows. Rows repeated
    as they are count as often as they occur, so their texts are repeated (if they are
    long enough). An empty table gives an empty one. Other columns pass through, but one named
    spans is replaced.
    """
    if not 8 <= gram <= length:
        raise ValueError("gram must be from 8 to length")
    keyed = _keyed(docs, id_col, text_col)
    runs = repeated_stretches(keyed, text_col, length, gram)

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def merged(found: pd.Series) -> pd.Series:
        out = []
        for ranges in found:
            spans: list[dict[str, int]] = []
            for x in sorted(ranges, key=lambda x: x["first"]):
                start, stop = x["first"], x["first"] + x["windows"] - 1 + length
                if spans and start <= spans[-1]["stop"]:
                    spans[-1]["stop"] = max(spans[-1]["stop"], stop)
                else:
                    spans.append({"start": start, "stop": stop})
            out.append(spans)
        return pd.Series(out)

    per_text = runs.groupBy("key").agg(F.collect_list(F.struct("first", "windows")).alias("found"))
    per_text = per_text.select("key", merged("found").alias("__spans"))
    joined = keyed.join(per_text.withColumnRenamed("key", "__found"), F.col("__key") == F.col("__found"), "left")
    return joined.select(*(F.col(c) for c in docs.columns if c != "spans"), F.col("__spans").alias("spans"))


def kept(text: Column, spans: Column) -> Column:
    """Struct (n_removed, n_spans, sha256) of a text without its spans, for rows with spans."""

    @F.pandas_udf("n_removed long, n_spans long, sha256 string")
    def of(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for t, ranges in zip(texts, found, strict=True):
            if t is None or ranges is None:
                rows.append((0, 0, None))
                continue
            data, at, digest, removed = t.encode(), 0, hashlib.sha256(), 0
            for x in ranges:
                digest.update(data[at : x["start"]])
                removed += x["stop"] - x["start"]
                at = x["stop"]
            digest.update(data[at:])
            rows.append((removed, len(ranges), digest.hexdigest()))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "sha256"])

    return of(F.when(spans.isNotNull(), text), spans)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``."""
    found = repeated_spans(docs.select(id_col, text_col), id_col, text_col, length)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = found.select(
        F.col(id_col).alias("id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        kept(text, F.col("spans")).alias("kept"),
        F.when(F.col("spans").isNull(), F.sha2(text.cast("binary"), 256)).alias("whole"),
    )
    return rows.select(
        "id", "n_bytes", "kept.n_removed", "kept.n_spans", F.coalesce("whole", "kept.sha256").alias("kept_sha256")
    )
