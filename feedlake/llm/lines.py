"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Sets are written with the rarest words first; two
sets as similar as asked must share a word within short prefixes of that order
(prefix filter), not too late in them (positional filter), and have like sizes
(length filter). What is left is verified by its Jaccard similarity. Equal sets are
met once, through the first line that has the set.

Many near copies of one line are not met in pairs. They are gathered around a centre, any
set of words, and written as their differences from it. With similarity p / q, a set that
lacks m of the centre's words and has a others weighs q m + p a, and two sets are similar
where their weights add up to no more than (q - p) times the centre's words, plus p + q for
each difference they share. So all members of up to half that weight are similar to each
other; counts by weight tell how many of them another set is similar to, and only members
for which the shared differences matter are met one by one.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.keyfilter import key_filter, may_hold
from feedlake.llm.textrules import LOWER, byte_slices, free_name
from feedlake.session import materialize

SIMILARITY = Fraction(4, 5)
#: The rarity table has a fixed size: words share counters, and ties are broken by
#: hash. Any common order gives right results; a finer one gives shorter lists.
COUNTER_BITS = 21
COUNTERS = 1 << COUNTER_BITS
_PART = 1 << 16
_SHIFTS = np.arange(16, dtype=np.uint64) * np.uint64(4)
#: Pairs, and bytes of text, that are verified together, on average.
VERIFY_PAIRS = 200_000
VERIFY_BYTES = 16 << 20
#: Bands of a set, words in a band, sets of a band that make a group, and sets its centre is
#: made of. They decide who is a member of what; the result is the same for any of them.
BANDS = 3
_BAND_WORDS = 3
GROUP = 32
CENTRE_SETS = 33
_CENTRE_WORDS = 1 << 18
_PLACE = 0x5851F42D
#: A word is common if more than one in 2^this many of all words falls into its counter.
_USUAL_BITS = 12
#: Counts from here on are ordered alike.
_COMMON_BITS = 16
_COMMON = (1 << _COMMON_BITS) - 1
#: Bytes whose words are hashed at a time; a longer word is hashed in one piece.
_CHUNK = 1 << 18
_SLICE = 1 << 20
_BLANK = re.compile(rb"[ \t-\r]")
_MULTIPLIER = 0x5851F42D4C957F2D
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _mixed(numbers: np.ndarray, odd: int) -> np.ndarray:
    """Numbers of 64 bits, scrambled; ``odd`` chooses how."""
    numbers = (numbers ^ (numbers >> np.uint64(31))) * np.uint64(odd)
    numbers = (numbers ^ (numbers >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return numbers ^ (numbers >> np.uint64(32))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    out = []
    for base in (_MULTIPLIER, _INVERSE):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of every word ``[^\\x20\\x09-\\x0D]+``, in order; lines count from 0.

    A word's hash is a polynomial in its bytes, a difference of running sums, so all
    words of a chunk are hashed at once.
    """
    hashes, lines, at, line = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0
    while at < len(data):
        end = at + _CHUNK
        cut = _BLANK.search(data, end) if end < len(data) else None
        end = cut.end() if cut else len(data)
        bytes_ = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.zeros(len(bytes_) + 2, bool)
        inside[1:-1] = (bytes_ > 32) | (bytes_ < 9) | ((bytes_ > 13) & (bytes_ < 32))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        up, down = _powers(1 << (len(bytes_) - 1).bit_length() if len(bytes_) > 1 else 1)
        sums = np.zeros(len(bytes_) + 1, np.uint64)
        np.cumsum((bytes_.astype(np.uint64) + np.uint64(1)) * up[: len(bytes_)], out=sums[1:])
        hashes.append(_mixed((sums[stops] - sums[starts]) * down[starts], 0xD6E8FEB86659FD93))
        breaks = np.flatnonzero(bytes_ == 10)
        lines.append(line + np.searchsorted(breaks, starts))
        line += len(breaks)
        at = end
    return np.concatenate(hashes), np.concatenate(lines)


@dataclass
class Sets:
    """The distinct words of the lines that have any: line k of them is line[k] of the
    text, and its words are hashes[first[k] : first[k + 1]]."""

    hashes: np.ndarray
    line: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first, append=len(self.hashes))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that stand for each word set: two sums of scrambled hashes."""
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(
            np.add.reduceat(_mixed(self.hashes, odd), self.first).view(np.int64)
            for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
        )

    def signatures(self) -> np.ndarray:
        """Sixteen counters of four bits: words by hash, 15 at most. The counters of two
        sets differ by no more in all than the sets differ in words."""
        owner = np.repeat(np.arange(len(self.first)), self.sizes)
        cells = owner * 16 + (self.hashes & np.uint64(15)).astype(np.int64)
        counts = np.minimum(np.bincount(cells, minlength=16 * len(self.first)), 15).reshape(-1, 16)
        return (counts.astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64).view(np.int64)

    def bands(self, common: np.ndarray) -> np.ndarray:
        """Numbers of 32 bits, BANDS for each set, each made of the least of its scrambled
        words in some orders: sets that differ in few words have most in common. Words that
        are ``common`` say little; they are left out where a quarter or more are not."""
        out = np.zeros((len(self.first), BANDS), np.int32)
        if not len(out):
            return out
        rarer = np.add.reduceat(~common, self.first, dtype=np.int64)
        left = np.where(common & np.repeat(rarer * 4 >= self.sizes, self.sizes), np.uint64(2**64 - 1), np.uint64(0))
        odds = iter(_powers(BANDS * _BAND_WORDS + 1)[0][1:])
        for k in range(BANDS):
            key = np.zeros(len(self.first), np.uint64)
            for _ in range(_BAND_WORDS):
                key = _mixed(key ^ np.minimum.reduceat(self.hashes * next(odds) | left, self.first), 0xFF51AFD7ED558CCD)
            out[:, k] = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return out


def sets_of(data: bytes, counts: np.ndarray | None = None) -> Sets:
    """Word sets of all lines; with ``counts``, each line's words by rarity, then hash."""
    hashes, line = words_of(data)
    if not len(hashes):
        return Sets(hashes, line, line)
    # One number of 64 bits orders line, rarity and as much of the hash as there is room for.
    bits = max(1, int(line[-1]).bit_length())
    rare = np.zeros(len(hashes), np.int64) if counts is None else np.minimum(counts[_slots(hashes)], _COMMON)
    place = line.astype(np.uint64) << np.uint64(64 - bits) | rare.astype(np.uint64) << np.uint64(64 - bits - _COMMON_BITS)
    place |= hashes >> np.uint64(bits + _COMMON_BITS)
    order = np.argsort(place)
    sorted_place, sorted_hashes = place[order], hashes[order]
    if ((sorted_place[1:] == sorted_place[:-1]) & (sorted_hashes[1:] != sorted_hashes[:-1])).any():
        order = np.lexsort((hashes, rare, line))
    hashes, line = hashes[order], line[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    hashes, line = hashes[fresh], line[fresh]
    first = np.flatnonzero(np.diff(line, prepend=-1))
    return Sets(hashes, line[first], first)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def rarity(texts: DataFrame, text_col: str) -> Broadcast:
    """How often words of each counter occur, over all lines; at most 2^31 - 1."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        waiting, size = [], 0
        for batch in batches:
            for _, _, held in byte_slices(batch["text"].tolist(), _SLICE):
                waiting.append(_slots(words_of(b"\n".join(held))[0]))
                size += len(waiting[-1])
                if size > COUNTERS:
                    total += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
                    waiting, size = [], 0
        if size:
            total += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
        for first in range(0, COUNTERS, _PART):
            used = np.flatnonzero(total[first : first + _PART])
            if len(used):
                n = total[first + used]
                yield pd.DataFrame({"first": [first], "at": [used.astype(np.uint16).tobytes()], "n": [n.tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_PART, np.int64)
        for at, n in zip(group["at"], group["n"], strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        total = np.minimum(total, 2**31 - 1).astype(np.int32)
        return pd.DataFrame({"first": group["first"][:1], "n": [total.tobytes()]})

    counted = texts.select(F.col(text_col).alias("text")).mapInPandas(count, "first int, at binary, n binary")
    table = np.zeros(COUNTERS, np.int32)
    for row in counted.groupBy("first").applyInPandas(add, "first int, n binary").collect():
        table[row["first"] : row["first"] + _PART] = np.frombuffer(row.n, np.int32)
    return texts.sparkSession.sparkContext.broadcast(table)


def _apart(a: str, b: str) -> Column:
    """Sum of the differences of two signatures' counters."""
    nibble = lambda c, k: F.shiftrightunsigned(c, 4 * k).bitwiseAND(15)
    return reduce(operator.add, (F.abs(nibble(a, k) - nibble(b, k)) for k in range(16)))


def _numbers(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of every line of some texts, numbers from 1."""
    lines = np.array([t.count(b"\n") + 1 for t in held])
    owner = np.repeat(np.arange(len(held)), lines)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lines) - lines, lines) + 1


def line_sets(docs: DataFrame, table: Broadcast, id_col: str, text_col: str, similarity: Fraction) -> DataFrame:
    """(id, line, hi, lo, n, bits, prefix, bands) of every line with a word; lines count from 1.

    ``prefix`` has short hashes of the rarest words, rarest first: as many as must hold
    one word of any set that is similar enough. A word that occurs once in all lines is
    marked by a zero, since no other set has it. A task gives it, and the ``bands``, once
    for equal lines.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        usual = int(counts.sum(dtype=np.int64)) >> _USUAL_BITS
        seen: set[int] = set()
        for batch in batches:
            for begin, _, held in byte_slices(batch.column(1).to_pylist(), _SLICE):
                found = sets_of(b"\n".join(held), counts)
                if not len(found.first):
                    continue
                owner, number = _numbers(held)
                (hi, lo), n = found.keys(), found.sizes
                fresh = np.zeros(len(n), bool)
                for k, key in enumerate(lo.tolist()):
                    if key not in seen:
                        seen.add(key)
                        fresh[k] = True
                length = np.where(fresh, n + 1 + -n * similarity.numerator // similarity.denominator, 0)
                stops = np.cumsum(length)
                within = np.arange(stops[-1]) - np.repeat(stops - length, length)
                words = found.hashes[np.repeat(found.first, length) + within]
                shared = counts[_slots(words)] > 1
                short = np.where(shared, words.astype(np.uint32) | np.uint32(1), np.uint32(0)).view(np.int32)
                offsets = pa.array(np.concatenate(([0], stops)).astype(np.int32))
                prefix = pa.ListArray.from_arrays(offsets, pa.array(short), mask=pa.array(~fresh))
                offsets = pa.array(np.concatenate(([0], np.cumsum(fresh * BANDS))).astype(np.int32))
                bands = found.bands(counts[_slots(found.hashes)] > usual)
                bands = pa.ListArray.from_arrays(offsets, pa.array(bands[fresh].ravel()), mask=pa.array(~fresh))
                columns = [
                    batch.column(0).take(pa.array(begin + owner[found.line])), pa.array(number[found.line].astype(np.int32)),
                    pa.array(hi), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(found.signatures()), prefix, bands,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "line", "hi", "lo", "n", "bits", "prefix", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, line int, hi long, lo long, n int, bits long, prefix array<int>, bands array<int>"
    return materialize(rows.mapInArrow(cut, schema), "lines")


def _smallest(similarity: Fraction) -> int:
    """Sets of fewer words than one miss costs can only be equal."""
    return -(-similarity.numerator // (similarity.denominator - similarity.numerator))


def homes(lines: DataFrame, similarity: Fraction) -> DataFrame:
    """(lo, band): of each set with a band that GROUP sets have, the band most sets have."""
    rows = lines.where((F.col("n") >= _smallest(similarity)) & F.col("bands").isNotNull())
    # Counted with what several tasks have given, then again without.
    often = rows.select(F.explode("bands").alias("band")).groupBy("band").count().where(F.col("count") >= GROUP)
    marks = key_filter(materialize(often.select("band"), "often"), "band")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1).flatten().to_numpy()
            may = np.flatnonzero(may_hold(marks.value, bands))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(may // BANDS)), pa.array(bands[may])], ["lo", "band"])

    rows = rows.select("lo", "bands").mapInArrow(held, "lo long, band int").distinct()
    rows = materialize(rows, "banded")
    large = rows.groupBy("band").agg(F.count("*").alias("sets")).where(F.col("sets") >= GROUP)
    best = rows.join(large, "band").groupBy("lo").agg(F.max(F.struct("sets", "band")).alias("best"))
    return materialize(best.select("lo", "best.band"), "homes")


def texts_at(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``places`` (hi, lo, id, line and more: a set and a line that has it) with its text, once.

    The scan hashes only the lines at these places, and what the filter mistakes for them.
    """
    place = F.xxhash64("id").bitwiseXOR(F.col("line").cast("long") * _PLACE)
    marks = key_filter(places.select(place.alias("place")), "place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for begin, _, held in byte_slices(batch.column(1).to_pylist(), _SLICE):
                owner, number = _numbers(held)
                may = np.flatnonzero(may_hold(marks.value, ids[begin + owner] ^ (number * _PLACE)))
                if not len(may):
                    continue
                split = b"\n".join(held).split(b"\n")
                split = [split[k] for k in may.tolist()]
                found = sets_of(b"\n".join(split))
                hi, lo = found.keys()
                fresh = []
                for k, key in enumerate(lo.tolist()):
                    if key not in seen:
                        seen.add(key)
                        fresh.append(k)
                if fresh:
                    text = [split[found.line[k]].decode() for k in fresh]
                    yield pa.RecordBatch.from_arrays([pa.array(hi[fresh]), pa.array(lo[fresh]), pa.array(text)], ["hi", "lo", "text"])

    rows = docs.select(F.xxhash64(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(cut, "hi long, lo long, text string")
    rows = rows.join(places.select("lo"), "lo", "left_semi").dropDuplicates(["lo", "hi"])
    return materialize(rows.join(places, ["hi", "lo"]), "texts")


def centres(sample: DataFrame, similarity: Fraction) -> DataFrame:
    """(band, cluster, words, bits) from ``sample`` (band, text), a few sets of each band: the
    words that most of those have that are similar to the one with most similar ones."""
    num, den = similarity.numerator, similarity.denominator

    def middle(group: pa.Table) -> pa.Table:
        found = sets_of(b"\n".join(t.encode() for t in group["text"].to_pylist()))
        few = max(1, int(np.searchsorted(np.cumsum(found.sizes), _CENTRE_WORDS, "right")))
        n = found.sizes[:few]
        words, at = np.unique(found.hashes[: n.sum()], return_inverse=True)
        held = np.zeros((len(n), len(words)), np.float32)
        held[np.repeat(np.arange(len(n)), n), at] = 1
        similar = (held @ held.T) * (num + den) >= (n[:, None] + n) * num
        some = similar[np.argmax(similar.sum(axis=1))]
        one = words[held[some].sum(axis=0) * 2 > some.sum()]
        one = Sets(one, np.zeros(1, np.int64), np.zeros(1, np.int64))
        columns = [group["band"][:1], pa.array(one.keys()[1]), pa.array([one.hashes.view(np.int64)]), pa.array(one.signatures())]
        return pa.table(columns, names=["band", "cluster", "words", "bits"])

    return sample.groupBy("band").applyInArrow(middle, "band int, cluster long, words array<long>, bits long")


def apart_from(rows: DataFrame, similarity: Fraction) -> DataFrame:
    """``rows`` (hi, lo, id, line, cluster, text, words) with, instead of the last two, what the
    text's set weighs against the centre's words, the weight that two may have in all
    (``most``), and the hashes in which they differ."""
    num, den = similarity.numerator, similarity.denominator
    kept = ["hi", "lo", "id", "line", "cluster"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, held in byte_slices(batch.column(5).to_pylist(), _SLICE):
                found = sets_of(b"\n".join(held))
                centre = batch.column(6).slice(begin, end - begin)
                sizes = np.diff(centre.offsets.to_numpy())
                hashes = np.concatenate([found.hashes, centre.flatten().to_numpy().view(np.uint64)])
                owner = np.concatenate([np.repeat(np.arange(end - begin), found.sizes), np.repeat(np.arange(end - begin), sizes)])
                added = np.arange(len(hashes)) < len(found.hashes)
                order = np.lexsort((hashes, owner))
                same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
                alone = np.ones(len(order), bool)
                alone[1:] &= ~same
                alone[:-1] &= ~same
                order = order[alone]
                cost = np.bincount(owner[order], np.where(added[order], num, den), end - begin).astype(np.int64)
                stops = np.concatenate(([0], np.cumsum(np.bincount(owner[order], minlength=end - begin)))).astype(np.int32)
                differ = pa.ListArray.from_arrays(pa.array(stops), pa.array(hashes[order].view(np.int64)))
                columns = [batch.column(k).slice(begin, end - begin) for k in range(5)]
                columns += [pa.array(cost), pa.array(sizes.astype(np.int64) * (den - num)), differ]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "weight", "most", "differ"])

    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"hi long, lo long, id {id_type}, line int, cluster long, weight long, most long, differ array<long>"
    return rows.select(*kept, "text", "words").mapInArrow(weigh, schema)


@dataclass
class Clusters:
    """``members``: as of apart_from, a row per set that belongs to a centre, all of one being
    similar; ``centres``: (cluster, words, bits, reach), reach being in how many words a set
    may differ that is similar to any member."""

    members: DataFrame
    centres: DataFrame


def clusters(texts: DataFrame, similarity: Fraction) -> Clusters:
    """Sets of ``texts`` (hi, lo, id, line, text, band) around the centre of their band; equal
    centres are one. Sets of more than half the weight, or of few members, have none."""
    num, den = similarity.numerator, similarity.denominator
    place = Window.partitionBy("band").orderBy(F.xxhash64("lo"), "lo")
    chosen = texts.select("band", "lo", "hi").withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= CENTRE_SETS)
    found = materialize(centres(texts.join(chosen.select("hi", "lo"), ["hi", "lo"]).select("band", "text"), similarity), "centres")
    rows = apart_from(texts.join(found.select("band", "cluster", "words"), "band"), similarity)
    near = materialize(rows.where(F.col("weight") * 2 <= F.col("most")), "near")
    large = near.groupBy("cluster").agg(F.count("*").alias("sets"), F.max("weight").alias("weight"), F.max("most").alias("most"))
    reach = F.floor((F.col("most") * num + F.col("weight") * den) / (num * num)).cast("int")
    large = materialize(large.where(F.col("sets") * 4 >= GROUP).select("cluster", reach.alias("reach")), "reach")
    kept = found.dropDuplicates(["cluster"]).drop("band").join(large, "cluster")
    return Clusters(materialize(near.join(large.select("cluster"), "cluster", "left_semi"), "members"), materialize(kept, "clusters"))


def candidates(lines: DataFrame, similarity: Fraction, grouped: Clusters | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, word): keys (lo) of sets that pass all filters, each pair once, a below b,
    and the least prefix word they share; and (lo, cluster) of sets and clusters not their
    own that may have a similar member. Members of clusters are in no pair.

    One shuffle by prefix word serves both sides of the join; sets that several tasks
    have given are made one behind it. A cluster is one row of a word, however large.
    """
    num, den = similarity.numerator, similarity.denominator
    lines = lines.where((F.col("n") >= _smallest(similarity)) & F.col("prefix").isNotNull())
    # Two numbers in one: what is left from the word on and the least size; of a cluster,
    # its reach and how much larger its sets may be (none: a set).
    own = ("word", "lo", "bits", "sizes", "span")
    packed = lambda high, low: F.shiftleft(F.col(high).cast("long"), 32) + F.col(low)
    high, low = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: F.col(c).bitwiseAND(2**31 - 1).cast("int"))

    def posted(rows: DataFrame, *more: str) -> DataFrame:
        rows = rows.select("lo", "n", "bits", *more, F.posexplode("prefix").alias("at", "word")).where("word <> 0")
        rows = rows.withColumn("rest", F.col("n") - F.col("at")).withColumn("sizes", packed("rest", "n"))
        return rows.withColumn("span", F.lit(None).cast("long")).select(*own, *more)

    if grouped is None:
        rows, both_kinds = posted(lines).repartition("word").dropDuplicates(own), False
    else:
        marks, both_kinds = key_filter(grouped.members, "lo"), True

        def held(lo: pd.Series) -> pd.Series:
            return pd.Series(may_hold(marks.value, lo.to_numpy()))

        lines = lines.withColumn("may", F.pandas_udf(held, "boolean")("lo"))
        member = grouped.members.select("lo", "cluster")
        may = lines.where("may").join(member, "lo", "left")
        inside = materialize(posted(may.where("cluster is not null"), "cluster").distinct(), "inside")
        n = low("sizes")
        summed = inside.groupBy("word", "cluster").agg(
            F.min(n).alias("n"), (F.max(n) - F.min(n)).alias("more"), F.max(high("sizes")).alias("rest")
        )
        around = summed.join(grouped.centres.select("cluster", "bits", "reach"), "cluster")
        around = around.select("word", F.col("cluster").alias("lo"), "bits", packed("rest", "n").alias("sizes"), packed("reach", "more").alias("span"))
        around = materialize(around, "around")
        # Written, so that both sides of the join are one shuffle.
        others = lines.where("not may").drop("may").unionByName(may.where("cluster is null").drop("may", "cluster"))
        others = materialize(others.select("lo", "n", "bits", "prefix"), "others")
        rows = posted(others).unionByName(around).repartition("word").dropDuplicates(own)

    def side(rows: DataFrame, name: str) -> DataFrame:
        found = rows.withColumns({"n": low("sizes"), "rest": high("sizes"), "single": F.col("span").isNull()})
        if both_kinds:
            found = found.withColumns({"more": F.coalesce(low("span"), F.lit(0)), "reach": F.coalesce(high("span") * (num + den), F.lit(-1))})
        return found.drop("sizes", "span").select("word", *(F.col(c).alias(f"{name}_{c}") for c in found.columns if c not in ("word", "sizes", "span")))

    both = F.col("a_n") + F.col("b_n")
    # Overlap needed, times num + den; what is left after the first shared word bounds it.
    rest = F.least("a_rest", "b_rest")
    b_most = F.col("b_n") if not both_kinds else F.col("b_n") + F.col("b_more")
    like_sizes = (F.col("a_n") * num <= b_most * den) & (F.col("b_n") * num <= F.col("a_n") * den)
    positional = rest * (num + den) >= both * num
    # In how many words two similar sets may differ; signatures differ in no more.
    apart, two = _apart("a_bits", "b_bits") * (num + den), both * (den - num)
    ordered, near = F.col("a_lo") < F.col("b_lo"), apart <= two
    if both_kinds:
        # A sum, since a condition on one side alone would be moved below the shuffle and make two of it.
        ordered = F.when(F.col("a_single"), 0).otherwise(1) + F.when(~F.col("b_single") | ordered, 0).otherwise(1) == 0
        near = apart <= F.when(F.col("b_single"), two).otherwise(F.col("b_reach"))
    found = side(rows, "a").join(side(rows, "b"), "word").where(ordered & like_sizes & positional & near)
    found = found.groupBy(F.col("a_lo").alias("a"), F.col("b_lo").alias("b"), (~F.col("b_single")).alias("visit"))
    found = materialize(found.agg(F.min("word").alias("word")), "candidates")
    pairs = found.where("not visit").select("a", "b", "word")
    if grouped is None:
        return pairs, None
    visitors = side(inside, "a").join(side(around, "b"), "word").where((F.col("a_cluster") != F.col("b_lo")) & like_sizes & positional & (apart <= F.col("b_reach")))
    visits = found.where("visit").select(F.col("a").alias("lo"), F.col("b").alias("cluster"))
    visits = visits.unionByName(visitors.select(F.col("a_lo").alias("lo"), F.col("b_lo").alias("cluster")).distinct())
    return pairs, materialize(visits, "visits")


def cluster_links(grouped: Clusters, visits: DataFrame, similarity: Fraction) -> DataFrame:
    """(hi, lo, n, id, line): links of members to members of their cluster, and links between
    members and ``visits``: as of apart_from, sets that are no members of that cluster; the
    place is that of the earliest. Rows of a set are to be added up.

    A visitor that belongs to another cluster visits there what visits it here, so only
    its own links are counted.
    """
    num, den = similarity.numerator, similarity.denominator
    bound = F.col("weight") * (2 * num) <= F.col("most") * (2 * num + den)
    strangers = visits.where(bound).join(grouped.members.select("lo", F.lit(True).alias("home")), "lo", "left")
    strangers = strangers.withColumn("home", F.coalesce("home", F.lit(False)))
    rows = grouped.members.withColumn("home", F.lit(None).cast("boolean")).unionByName(strangers)
    rows = materialize(rows, "weighed")
    member = F.col("home").isNull()
    here = F.struct("id", "line")
    counted = rows.where(F.coalesce(~F.col("home"), F.lit(True))).groupBy("cluster", "weight").agg(
        F.sum(member.cast("long")).alias("members"), F.count("*").alias("all"),
        F.min(F.when(member, here)).alias("member"), F.min(here).alias("any"),
    )
    steps = counted.groupBy("cluster").agg(F.collect_list(F.struct("weight", "members", "all", "member", "any")).alias("steps"))
    asked = rows.select("hi", "lo", "cluster", "weight", "most", member.alias("inside")).join(steps, "cluster")
    light = F.filter("steps", lambda s: s["weight"] + F.col("weight") <= F.col("most"))
    asked = asked.select("hi", "lo", "inside", light.alias("light"))
    n = F.aggregate("light", F.lit(0).cast("long"), lambda t, s: t + F.when(F.col("inside"), s["all"]).otherwise(s["members"]))
    first = F.array_min(F.transform("light", lambda s: F.when(F.col("inside"), s["any"]).otherwise(s["member"])))
    sure = asked.select("hi", "lo", (n - F.col("inside").cast("long")).alias("n"), first.alias("at")).where("n > 0")

    # Too heavy together but for what they share: only differences can make these similar.
    heaviest = rows.groupBy("cluster").agg(
        F.max(F.when(member, F.col("weight"))).alias("inside_most"), F.max(F.when(~member, F.col("weight"))).alias("visit_most")
    )
    told = rows.join(heaviest, "cluster")
    other = F.when(member, F.col("visit_most")).otherwise(F.col("inside_most"))
    told = told.where(F.col("weight") + other > F.col("most"))
    told = told.select("hi", "lo", "id", "line", "cluster", "weight", "most", "home", F.explode("differ").alias("word"))
    a = told.where(member).select("cluster", "word", *(F.col(c).alias(f"a_{c}") for c in ("hi", "lo", "id", "line", "weight")))
    b = told.where(~member).select("cluster", "word", "most", "home", *(F.col(c).alias(f"b_{c}") for c in ("hi", "lo", "id", "line", "weight")))
    both = F.col("a_weight") + F.col("b_weight")
    met = a.join(b, ["cluster", "word"]).where(both > F.col("most"))
    met = met.groupBy("a_hi", "a_lo", "b_hi", "b_lo", "cluster").agg(
        F.count("*").alias("shared"), *(F.first(c).alias(c) for c in ("a_id", "a_line", "a_weight", "b_id", "b_line", "b_weight", "most", "home"))
    )
    met = materialize(met.where(both <= F.col("most") + F.col("shared") * (num + den)), "met")
    one = F.lit(1).cast("long").alias("n")
    given = met.select(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo"), one, F.struct(F.col("a_id").alias("id"), F.col("a_line").alias("line")).alias("at"))
    back = met.where(~F.col("home")).select(
        F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"), one, F.struct(F.col("b_id").alias("id"), F.col("b_line").alias("line")).alias("at")
    )
    return sure.unionByName(given).unionByName(back).select("hi", "lo", "n", "at.id", "at.line")


def verify_parts(
    pairs: DataFrame, size: int, ends: DataFrame | None = None, most: int = VERIFY_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(part, a, b) of all pairs, and (part, lo): the sets that each part may need, worked
    out from the sets of each word, not from their pairs.

    Pairs are dealt by their word. One with more than ``size`` pairs, or whose texts
    (``ends``: word, lo, bytes) have more than ``most`` bytes, is a grid, split by hashes
    of both ends: k times k cells cost each of its texts 2 k copies.
    """
    heavy = pairs.groupBy("word").agg(F.count("*").alias("n")).withColumn("bytes", F.lit(0))
    total = 0
    if ends is not None:
        weighed = materialize(ends.groupBy("word").agg(F.sum("bytes").alias("bytes")), "weights")
        total = weighed.agg(F.sum("bytes")).first()[0] or 0
        heavy = heavy.drop("bytes").join(weighed, "word")
    side = F.greatest(F.ceil(F.sqrt(F.col("n") / size)), F.ceil(F.col("bytes") * 2 / most)).cast("int")
    heavy = materialize(heavy.where((F.col("n") > size) | (F.col("bytes") > most)).select("word", "bytes", side.alias("side")), "heavy")
    # A grid's texts are there 2 k times.
    total += heavy.agg(F.sum(F.col("bytes") * (2 * F.col("side") - 1))).first()[0] or 0
    heavy = heavy.select("word", "side")
    parts = max(1, -(-pairs.count() // size), -(-total // most))
    row = column = F.lit(0).cast("long")
    if ends is None:
        ends = pairs.select("word", F.col("a").alias("lo")).unionByName(pairs.select("word", F.col("b").alias("lo")))
    members = ends.select("word", "lo").distinct()
    cells = F.array(F.struct(row.alias("r"), column.alias("c")))
    if not heavy.isEmpty():
        pairs, members = pairs.join(heavy, "word", "left"), members.join(heavy, "word", "left")
        side = F.coalesce("side", F.lit(1)).cast("long")
        row, column, own = (F.pmod(F.xxhash64(c), side) for c in ("a", "b", "lo"))
        lines = F.sequence(F.lit(0).cast("long"), side - 1)
        cells = F.array_union(
            F.transform(lines, lambda c: F.struct(own.alias("r"), c.alias("c"))),
            F.transform(lines, lambda r: F.struct(r.alias("r"), own.alias("c"))),
        )
    part = lambda r, c: F.pmod(F.xxhash64("word", r, c), F.lit(parts)).cast("int").alias("part")
    placed = members.select("word", "lo", F.explode(cells).alias("cell"))
    needed = placed.select(part(F.col("cell.r"), F.col("cell.c")), "lo").distinct()
    return pairs.select(part(row, column), "a", "b"), needed


def shared_words(sets: Sets, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words each pair of sets has in common; ``words``: the hashes as small numbers."""
    sizes = sets.sizes
    out = np.zeros(len(a), np.int64)
    ends = np.cumsum(sizes[a] + sizes[b])
    at = 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
        keys = []
        for side in (a[at:stop], b[at:stop]):
            n = sizes[side]
            pair = np.repeat(np.arange(stop - at), n)
            within = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            keys.append(pair << 32 | words[np.repeat(sets.first[side], n) + within])
        both = np.sort(np.concatenate(keys))
        out[at:stop] = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=stop - at)
        at = stop
    return out


def links(
    docs: DataFrame, lines: DataFrame, sets: DataFrame, id_col: str, text_col: str, similarity: Fraction
) -> DataFrame:
    """(hi, lo, n_links, there): of each set that has similar ones, how many, and the first
    place (id, line) of the earliest.

    Only the texts of candidates and of large groups are shuffled. Groups of near copies are
    counted around their centres; other pairs meet their texts by a prefix word they share,
    in parts of bounded size (see verify_parts). A part verifies its pairs and returns a row
    per set, not per pair.
    """
    home, grouped = homes(lines, similarity), None
    if not home.isEmpty():
        grouped_texts = texts_at(docs, materialize(sets.join(home, "lo"), "places"), id_col, text_col)
        grouped = clusters(grouped_texts, similarity)
        grouped_texts = grouped_texts.drop("band")
    pairs, visits = candidates(lines, similarity, grouped)
    ends = pairs.select(F.col("a").alias("lo"), "word").unionByName(pairs.select(F.col("b").alias("lo"), "word"))
    wanted = materialize(ends.distinct(), "wanted")
    asked = wanted.select("lo")
    if grouped is not None:
        asked = asked.unionByName(visits.select("lo")).distinct().join(home, "lo", "left_anti")
    places = materialize(sets.join(asked.distinct(), "lo", "left_semi"), "places")
    texts = texts_at(docs, places, id_col, text_col)
    if grouped is not None:
        texts = texts.unionByName(grouped_texts)
    clustered = None
    if grouped is not None:
        rows = texts.join(visits, "lo").join(grouped.centres.select("cluster", "words"), "cluster")
        clustered = cluster_links(grouped, apart_from(rows, similarity), similarity)

    bytes_of = texts.groupBy("lo").agg(F.max(F.octet_length("text")).alias("bytes"))
    dealt, needed = verify_parts(pairs, VERIFY_PAIRS, wanted.join(bytes_of, "lo"))
    placed = texts.join(needed, "lo").select("part", "hi", "lo", "id", "line", "text")
    num, den = similarity.numerator, similarity.denominator
    id_type = sets.schema["id"].dataType.simpleString()

    def verify(pair: pa.Table, line: pa.Table) -> pa.Table:
        found = sets_of(b"\n".join(t.encode() for t in line["text"].to_pylist()))
        words = np.unique(found.hashes, return_inverse=True)[1]
        keyed = pd.DataFrame({"lo": line["lo"].to_numpy(), "k": np.arange(line.num_rows)})
        both = pair.select(["a", "b"]).to_pandas().merge(keyed, left_on="a", right_on="lo")
        both = both.merge(keyed, left_on="b", right_on="lo", suffixes=("", "_b"))
        a, b, n = both["k"].to_numpy(), both["k_b"].to_numpy(), found.sizes
        shared = shared_words(found, words, a, b)
        similar = shared * den >= (n[a] + n[b] - shared) * num
        a, b = a[similar], b[similar]
        order = pc.sort_indices(line, [("id", "ascending"), ("line", "ascending")], null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        best = np.full(len(order), len(order))
        np.minimum.at(best, a, place[b])
        np.minimum.at(best, b, place[a])
        count = np.bincount(a, minlength=len(order)) + np.bincount(b, minlength=len(order))
        some = np.flatnonzero(count)
        other = line.take(pa.array(order[best[some]]))
        mine = line.take(pa.array(some))
        columns = [mine["hi"], mine["lo"], pa.array(count[some]), other["id"], other["line"]]
        return pa.table(columns, names=["hi", "lo", "n", "id", "line"])

    together = dealt.withColumnRenamed("part", "of_part").groupBy("of_part").cogroup(placed.groupBy("part"))
    found = together.applyInArrow(verify, f"hi long, lo long, n long, id {id_type}, line int")
    if clustered is not None:
        found = found.unionByName(clustered)
    return found.groupBy("hi", "lo").agg(F.sum("n").alias("n_links"), F.min(F.struct("id", "line")).alias("there"))


def similar_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Fraction = SIMILARITY
) -> DataFrame:
    """One row per line with a word: (id, line, first_id, first_line, n_links, match_id,
    match_line, removed, hi, lo).

    ``first_*``: the earliest line with the same words, which names the line's class.
    ``n_links``: how many other classes are similar. ``match_*``: the earliest line of
    its own or a similar class; the line is ``removed`` if that is another line. Lines
    are ordered by id and number; a row without an id comes first. Rows that share an
    id are one document whose equal lines stay or go together. Lines without a word are
    never removed and have no row; texts and lines of any length are read whole. A null
    text has no lines; an empty table has none either; other columns are not read.
    """
    table = rarity(docs, text_col)
    lines = line_sets(docs, table, id_col, text_col, similarity)
    first = F.min(F.struct("id", "line")).alias("first")
    sets = lines.groupBy("hi", "lo").agg(first).select("hi", "lo", "first.id", "first.line")
    sets = materialize(sets, "sets")
    best = links(docs, lines, sets, id_col, text_col, similarity)
    here = F.struct("id", "line")
    classes = sets.join(best, ["hi", "lo"], "left").select(
        "hi", "lo", here.alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.least(here, F.coalesce("there", here)).alias("match"),
    )
    keyed = lines.select("id", "line", "hi", "lo").distinct()
    placed = keyed.join(classes, ["hi", "lo"])
    same = F.col("id").eqNullSafe(F.col("match.id")) & (F.col("line") == F.col("match.line"))
    return placed.select(
        "id", "line",
        F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"),
        "n_links",
        F.col("match.id").alias("match_id"), F.col("match.line").alias("match_line"),
        (~same).alias("removed"), "hi", "lo",
    )


def nameless_marks(rows: DataFrame, gone: DataFrame, text_col: str, row_col: str = "__row") -> DataFrame:
    """(row_col, marks): of each row without an id, by its row key, the lines in ``gone``
    (line, hi, lo). Such rows share one id, null, so their lines are met by what they
    hold and no list is longer than its text has lines."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, held in byte_slices(batch.column(1).to_pylist(), _SLICE):
                found = sets_of(b"\n".join(held))
                owner, number = _numbers(held)
                rows_ = batch.column(0).take(pa.array(begin + owner[found.line]))
                hi, lo = found.keys()
                columns = [rows_, pa.array(number[found.line].astype(np.int32)), pa.array(hi), pa.array(lo)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "line", "hi", "lo"])

    texts = rows.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    lines = texts.mapInArrow(cut, "row long, line int, hi long, lo long")
    found = lines.join(gone.select("line", "hi", "lo"), ["line", "hi", "lo"], "left_semi")
    marked = found.groupBy("row").agg(F.collect_list(F.struct("line", "hi", "lo")).alias("marks"))
    return marked.withColumnRenamed("row", row_col)


def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    """Texts without the marked lines; a mark holds where its line has the marked words."""
    out = []
    for text, marks in zip(texts, removed, strict=True):
        if text is not None and marks is not None:
            found = sets_of(text.encode().translate(LOWER))
            hi, lo = found.keys()
            at = {line: k for k, line in enumerate(found.line.tolist())}
            drop = set()
            for x in marks:
                k = at.get(x["line"] - 1)
                if k is not None and (hi[k], lo[k]) == (x["hi"], x["lo"]):
                    drop.add(x["line"] - 1)
            text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in drop)
        out.append(text)
    return pd.Series(out, dtype=object)


def drop_later_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Fraction = SIMILARITY
) -> DataFrame:
    """``docs`` without the lines that similar_lines removes; all rows stay, a text whose
    lines all go becomes empty, a null text stays null. A column n_chars, if there,
    follows the text. Columns may have any names."""
    gone = similar_lines(docs, id_col, text_col, similarity).where("removed").select("id", "line", "hi", "lo")
    gone = materialize(gone, "gone")
    key, list_, row = (free_name(docs, c) for c in ("gone_id", "gone_lines", "gone_row"))
    marks = F.collect_list(F.struct("line", "hi", "lo")).alias(list_)
    named = gone.where("id is not null").groupBy(F.col("id").alias(key)).agg(marks)
    nameless = docs.where(F.col(id_col).isNull())
    joined = docs.join(named, F.col(id_col) == F.col(key), "left").drop(key)
    if not nameless.isEmpty():
        joined = joined.where(F.col(id_col).isNotNull())
        rows = materialize(nameless.withColumn(row, F.monotonically_increasing_id()), "nameless")
        own = nameless_marks(rows, gone.where("id is null"), text_col, row).withColumnRenamed("marks", list_)
        joined = joined.unionByName(rows.join(own, row, "left").drop(row))
    changed = joined.withColumn(text_col, F.pandas_udf(_without, "string")(F.col(text_col), F.col(list_)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.length(text_col).cast(kind)
        changed = changed.withColumn("n_chars", F.when(F.col(list_).isNull(), F.col("n_chars")).otherwise(length))
    return changed.select(*docs.columns)
