"""Language-model scores from a hashed maximum-entropy model.

P(word | history) is factored three times, each factor a softmax with weights of hashed
n-gram and skip features: over groups of classes, over the classes of the word's group,
and over the words of its class. The most frequent words are classes of their own; the
rest fall into classes by ending.

The first two factors have few outputs and a weight table of fixed size. In each round
every task runs mini-batches over its share of the documents, starting from the same
weights, and the changes are averaged row by row; the rounds share out all training
documents. The third factor has a weight for every word and every hashed history (of the
last word, and of the one before it) the word was seen with, so what it gathers grows
with the corpus and never meets in one place: words are dealt to shards by hash. Its
gradient needs one sum for each class and pair of histories, a small table that Spark
adds up in each round; a task works its words' weights out again from these tables, so
that no weights are stored between rounds.

Text is read once: tasks cut the corpus into blocks of numbered words with a dictionary
each. Parts of dictionaries meet by shard, and each block is scored with what the shards
say of its own dictionary alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.llm.textrules import space_words
from feedlake.session import materialize

HEADS = 56
TAILS = 40
CLASSES = HEADS + TAILS
#: Classes in order fall into groups of this size.
GROUP = 8
GROUPS = CLASSES // GROUP
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
FEATURES = 4
#: The features that tell classes of a group apart: the last word, the last two.
INNER = (0, FEATURES - 1)
ROUNDS = 3
RATE = 0.12
BATCH = 4096
#: Histories of a word within its class: hashes of the last word, and of the one before.
HISTORIES = 16
SIDES = 2 * HISTORIES
#: Rounds of the words' weights, by turns on either kind of history, and their prior.
WORD_ROUNDS = 4
WORD_PRIOR = 2.0
#: Text of one block; a longer document is a block of its own.
BLOCK_BYTES = 32 << 20
#: Text for which there is one shard of words.
SHARD_BYTES = 16 << 20
#: Rows of the weight table that travel together.
ROWS = 128
#: The token at the end of every text; no word is empty.
END = b""
#: Stands for the words before the first one.
BEFORE = np.uint32(0x5BD1E995)


def word_hash(token: bytes) -> int:
    return zlib.crc32(token)


def ending(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % TAILS


@dataclass
class Classes:
    """Hashes of the head words in order of frequency; words in all and distinct of each class."""

    heads: list[int]
    total: np.ndarray
    distinct: np.ndarray

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Classes of words. A word with the hash of a head word is of its class."""
        kinds = endings.astype(np.int64) + HEADS
        if self.heads:
            heads = np.array(self.heads, np.uint32)
            order = np.argsort(heads)
            place = order[np.minimum(np.searchsorted(heads, hashes, sorter=order), len(heads) - 1)]
            kinds = np.where(heads[place] == hashes, place, kinds)
        return kinds


def back(hashes: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
    """The hash so many words before each position of its text."""
    shifted = np.zeros_like(hashes)
    shifted[steps:] = hashes[:-steps]
    return np.where(at >= steps, shifted, BEFORE)


def histories(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the last word and of the one before it at each position."""
    return tuple((back(hashes, at, steps) >> np.uint32(28)).astype(np.uint8) for steps in (1, 2))


def features(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(FEATURES, n) buckets from the words before each position of its text: the last
    one, those two and three back (skips), and the last two together."""
    before = [back(hashes, at, steps) for steps in (1, 2, 3)]
    pair = before[0] * np.uint32(0x85EBCA6B) ^ before[1]
    out = np.empty((FEATURES, len(hashes)), np.int32)
    for j, value in enumerate([*before, pair]):
        mixed = (value ^ np.uint32((j + 1) * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0xCC9E2D51)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x1B873593)
        out[j] = mixed >> np.uint32(32 - BUCKET_BITS)
    return out


class Weights:
    """Weights of groups, a row per bucket, and of classes, a row per bucket and group;
    and the biases, which stay as counted."""

    def __init__(self, totals: np.ndarray, both: np.ndarray | None = None):
        prior = (totals + 0.5).reshape(GROUPS, GROUP)
        self.group_bias = np.log(prior.sum(axis=1) / prior.sum()).astype(np.float32)
        self.class_bias = np.log(prior / prior.sum(axis=1, keepdims=True)).astype(np.float32)
        both = np.zeros((BUCKETS, GROUPS + CLASSES), np.float32) if both is None else both
        self.group = both[:, :GROUPS].copy()
        self.classes = both[:, GROUPS:].reshape(BUCKETS * GROUPS, GROUP).copy()

    def both(self) -> np.ndarray:
        return np.hstack([self.group, self.classes.reshape(BUCKETS, CLASSES)])

    def logs(self, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities of all groups, of the classes in each position's group, and
        the rows of the class weights that say so."""
        group = classes // GROUP
        inner = rows[INNER, :] * np.int32(GROUPS) + group.astype(np.int32)
        outer = np.repeat(self.group_bias[None], rows.shape[1], axis=0)
        return _log_softmax(outer, self.group, rows), _log_softmax(self.class_bias[group], self.classes, inner), inner


def _log_softmax(z: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    for row in rows:
        z += table.take(row, axis=0, mode="clip")
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def class_log10(weights: Weights, hashes: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 P(class | history) at every position."""
    rows = features(hashes, at)
    out = np.empty(len(hashes))
    for start in range(0, len(hashes), BATCH):
        part = slice(start, start + BATCH)
        kinds = classes[part]
        outer, inner, _ = weights.logs(rows[:, part], kinds)
        places = np.arange(len(kinds))
        out[part] = outer[places, kinds // GROUP] + inner[places, kinds % GROUP]
    return out / math.log(10)


def _descend(table: np.ndarray, squares: np.ndarray, used: np.ndarray, error: np.ndarray) -> None:
    """One AdaGrad step on the summed slope of each row; ``used`` has equal rows together."""
    firsts = np.flatnonzero(np.diff(used, prepend=-1))
    rows = used[firsts]
    slope = np.add.reduceat(error, firsts)
    seen = squares.take(rows, axis=0)
    seen += slope * slope
    squares[rows] = seen
    seen += 1
    np.sqrt(seen, out=seen)
    slope *= RATE
    slope /= seen
    table[rows] -= slope


def learn(weights: Weights, squares: Weights, hashes: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Mini-batches in place; returns how often each bucket was used."""
    rows = features(hashes, at)
    for start in range(0, len(hashes), BATCH):
        part = slice(start, start + BATCH)
        batch, kinds = rows[:, part], classes[part]
        outer, inner, inner_rows = weights.logs(batch, kinds)
        places = np.arange(len(kinds))
        group = kinds // GROUP
        np.exp(outer, out=outer)
        np.exp(inner, out=inner)
        outer[places, group] -= 1
        inner[places, kinds % GROUP] -= 1
        # One order per feature, by bucket and then by group, serves both tables.
        by_group = np.argsort(group.astype(np.uint8), kind="stable")
        for j, row in enumerate(batch):
            order = by_group[np.argsort(row[by_group].astype(np.uint16), kind="stable")]
            _descend(weights.group, squares.group, row[order], outer.take(order, axis=0))
            if j in INNER:
                used = inner_rows[INNER.index(j)][order]
                _descend(weights.classes, squares.classes, used, inner.take(order, axis=0))
    return np.bincount(rows.ravel(), minlength=BUCKETS)


def positions(lengths: np.ndarray) -> np.ndarray:
    """The position of every token in its text, for texts one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


BLOCK_FIELDS = "words binary, lengths binary, held binary, hashes binary, endings binary"
PART_FIELDS = "shard integer, tokens binary, numbers binary, n binary, cells binary, times binary"


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _steps(values: np.ndarray) -> bytes:
    """Ascending numbers below 2^31 as packed differences, most of them one small byte."""
    return _packed(np.diff(values, prepend=0).astype(np.int32))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.int32), dtype=np.int64)


def blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """Documents as numbered words, and parts of the dictionaries that explain them.

    A row with ``words`` is a block: its documents one after the other, and the hash and
    ending of every word of its dictionary. The other rows are those words of a block
    that are of one shard, with their numbers, how often training texts have them there,
    and how often after which history (``cells``: place in the part times SIDES plus
    bucket, those of the word before the last one after those of the last). One table
    holds both, so that a task run again replaces both.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType())])
    schema = schema.add("ids", T.ArrayType(T.StructType([T.StructField("id", id_type)])))
    for field in (BLOCK_FIELDS + ", " + PART_FIELDS).split(", "):
        schema = schema.add(*field.split(" "))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES

    def parts(numbers: dict[bytes, int], hashes: np.ndarray, words, lengths, held) -> Iterator[tuple]:
        tokens = np.empty(len(numbers), object)
        tokens[:] = list(numbers)
        shard = hashes % np.uint32(shards)
        order = np.argsort(shard, kind="stable")
        firsts = np.flatnonzero(np.diff(shard[order].astype(np.int64), prepend=-1))
        ends = np.append(firsts[1:], len(tokens))
        # Words are numbered anew by shard, so that one sort brings cells into shards too.
        kind = np.int32 if len(tokens) * SIDES < 1 << 31 else np.int64
        place = np.empty(len(tokens), kind)
        place[order] = np.arange(len(tokens), dtype=kind)
        learned = np.repeat(~held, lengths)
        last, skip = (g[learned] for g in histories(hashes[words], positions(lengths)))
        kept = place[words[learned]]
        n = np.bincount(kept, minlength=len(tokens)).astype(np.int32)
        kept *= SIDES
        cells, times = np.unique(np.concatenate([kept + last, kept + (skip + HISTORIES)]), return_counts=True)
        times = times.astype(np.int32)
        bounds = np.searchsorted(cells, np.append(firsts, len(tokens)).astype(np.int64) * SIDES)
        for first, end, low, high in zip(firsts, ends, bounds[:-1], bounds[1:], strict=True):
            mine = order[first:end]
            yield (
                int(shard[mine[0]]), b" ".join(tokens[mine]), _steps(mine), _packed(n[first:end]),
                _steps(cells[low:high] - first * SIDES), _packed(times[low:high]),
            )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, size = TaskContext.get().partitionId() << 32, 0
        numbers: dict[bytes, int] = {}
        held: list[bool] = []
        ids: list[object] = []
        coded: list[np.ndarray] = []

        def whole() -> Iterator[pd.DataFrame]:
            words, lengths, hold = np.concatenate(coded), np.array([len(c) for c in coded]), np.array(held, bool)
            hashes = np.fromiter(map(word_hash, numbers), np.uint32, len(numbers))
            endings = np.fromiter(map(ending, numbers), np.uint8, len(numbers))
            row = (
                block, ids, _packed(words), _packed(lengths), hold.tobytes(), hashes.tobytes(), endings.tobytes(),
                *[None] * 6,
            )
            yield pd.DataFrame([row], columns=schema.names, dtype=object)
            rest = [(block, *[None] * 6, *part) for part in parts(numbers, hashes, words, lengths, hold)]
            yield pd.DataFrame(rest, columns=schema.names, dtype=object)

        for batch in batches:
            for i, hold, text in zip(batch["id"].astype(object), batch["held_out"], batch["text"], strict=True):
                words = [*space_words(text), END]
                coded.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32))
                held.append(bool(hold))
                ids.append({"id": None if pd.isna(i) else i})
                size += len(text or "") + 1
                if size >= BLOCK_BYTES:
                    yield from whole()
                    block, size = block + 1, 0
                    numbers, held, ids, coded = {}, [], [], []
        if ids:
            yield from whole()

    return materialize(rows.mapInPandas(cut, schema), "blocks")


def dictionary(staged: DataFrame) -> DataFrame:
    """One row per shard: its words, in how many places of the training texts and after
    which histories, and which number of which block is which word."""
    schema = (
        "shard int, hashes binary, endings binary, c binary, cells binary, times binary, "
        "leaders array<struct<token: binary, c: long>>, blocks array<long>, numbers array<binary>, places array<binary>"
    )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        places, n, cells, times = [], [], [], []
        for row in group.itertuples():
            place = np.array([known.setdefault(t, len(known)) for t in bytes(row.tokens).split(b" ")], np.int64)
            places.append(place)
            n.append(_unpacked(row.n, np.int32))
            cell = _from_steps(row.cells)
            cells.append(place[cell // SIDES] * SIDES + cell % SIDES)
            times.append(_unpacked(row.times, np.int32))
        c = np.bincount(np.concatenate(places), np.concatenate(n), len(known)).astype(np.int64)
        cells, which = np.unique(np.concatenate(cells), return_inverse=True)
        times = np.bincount(which, np.concatenate(times), len(cells)).astype(np.int64)
        tokens = list(known)
        # Ties at the last place are all kept: the first by token are wanted.
        least = np.sort(c)[-HEADS:][0]
        first = sorted(((-int(c[k]), tokens[k]) for k in np.flatnonzero(c >= max(least, 1))))[:HEADS]
        return pd.DataFrame(
            {
                "shard": group["shard"][:1],
                "hashes": [np.fromiter(map(word_hash, tokens), np.uint32, len(tokens)).tobytes()],
                "endings": [np.fromiter(map(ending, tokens), np.uint8, len(tokens)).tobytes()],
                "c": [_packed(c)], "cells": [_steps(cells)], "times": [_packed(times)],
                "leaders": [[{"token": token, "c": -less} for less, token in first]],
                "blocks": [group["block"].tolist()],
                "numbers": [[bytes(b) for b in group["numbers"]]],
                "places": [[_packed(p.astype(np.int32)) for p in places]],
            }
        )

    parts = staged.where("shard is not null").select("block", *[f.split(" ")[0] for f in PART_FIELDS.split(", ")])
    return materialize(parts.groupBy("shard").applyInPandas(merge, schema), "words")


def count_classes(words: DataFrame) -> Classes:
    """Head words, and words in all and distinct of each class. What comes to the driver
    are HEADS words and CLASSES sums."""
    leaders = words.select(F.explode("leaders").alias("w")).select("w.*")
    found = leaders.orderBy(F.col("c").desc(), "token").limit(HEADS).collect()
    heads = list(dict.fromkeys(word_hash(bytes(r.token)) for r in found))
    classes = Classes(heads, np.zeros(CLASSES), np.zeros(CLASSES))

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                kinds, c, *_ = shard_words(row, classes)
                n, v = np.bincount(kinds, c, CLASSES).astype(np.int64), np.bincount(kinds, minlength=CLASSES)
                yield pd.DataFrame({"k": np.arange(CLASSES), "n": n, "v": v})

    told = words.select("hashes", "endings", "c", "cells", "times").mapInPandas(sizes, "k int, n long, v long")
    for r in told.groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        classes.total[r.k], classes.distinct[r.k] = r.n, r.v
    return classes


def shard_words(row, classes: Classes) -> tuple[np.ndarray, ...]:
    """Class and count of a shard's learned words, their cells and how often each was
    seen; and the places of these words in the shard. Words come by class."""
    kinds = classes.of(np.frombuffer(row.hashes, np.uint32), np.frombuffer(row.endings, np.uint8))
    c = _unpacked(row.c, np.int64)
    order = np.flatnonzero(c)
    order = order[np.argsort(kinds[order], kind="stable")]
    rank = np.zeros(len(c), np.int64)
    rank[order] = np.arange(len(order))
    cells, times = _from_steps(row.cells), _unpacked(row.times, np.int64)
    return kinds[order], c[order], rank[cells // SIDES] * SIDES + cells % SIDES, times, order


def word_weights(kinds: np.ndarray, c: np.ndarray, cells: np.ndarray, times: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """(words, 2, HISTORIES) weights after as many rounds as there are tables.

    A table holds, for each class and pair of histories, how many training words there
    are over the sum of the class's softmax at the time. One step per round on one kind
    of history: the slope (seen, less expected, less prior) over a bound of the curvature.
    Only histories a word was seen with have a weight.
    """
    weights = np.zeros((len(c), 2, HISTORIES), np.float32)
    flat = weights.reshape(-1)
    bounds = np.searchsorted(kinds, np.arange(CLASSES + 1))
    for r, table in enumerate(tables):
        side = r % 2
        raised = np.exp(weights)
        reach = np.empty((len(c), HISTORIES), np.float32)
        for k in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[k], bounds[k + 1])
            ratio = table[k].astype(np.float32)
            reach[part] = raised[part, 1 - side] @ (ratio if side else ratio.T)
        reach *= raised[:, side] * (c[:, None] + 1)
        mine = cells % SIDES // HISTORIES == side
        at, seen = cells[mine], times[mine]
        expected = reach[at // SIDES, at % HISTORIES]
        flat[at] += (seen - expected - WORD_PRIOR * flat[at]) / (np.maximum(seen, expected) + WORD_PRIOR)
    return weights


def word_sums(kinds: np.ndarray, c: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(CLASSES, HISTORIES, HISTORIES) sums of the softmax of these words."""
    out = np.zeros((CLASSES, HISTORIES, HISTORIES))
    bounds = np.searchsorted(kinds, np.arange(CLASSES + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[k], bounds[k + 1])
        raised = np.exp(weights[part].astype(np.float64))
        out[k] = ((c[part, None] + 1) * raised[:, 0]).T @ raised[:, 1]
    return out


def _cells(rows: DataFrame) -> np.ndarray:
    """(cell, n) rows summed into a table, which has the same size at every input."""
    out = np.zeros(CLASSES * HISTORIES * HISTORIES)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(CLASSES, HISTORIES, HISTORIES)


def learn_words(staged: DataFrame, words: DataFrame, classes: Classes) -> tuple[list[np.ndarray], np.ndarray]:
    """The tables of all rounds, and the logs of the sums at the end. All unseen words
    of a class share one unit of its sum, as in the base score."""

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(CLASSES * HISTORIES * HISTORIES, np.int64)
        for batch in batches:
            for row in batch.itertuples():
                block = Block(row, classes)
                last, skip = histories(block.hashes, block.at)
                cell = ((block.kinds * HISTORIES + last) * HISTORIES + skip)[np.repeat(~block.held, block.lengths)]
                n += np.bincount(cell, minlength=len(n))
        used = np.flatnonzero(n)
        yield pd.DataFrame({"cell": used, "n": n[used].astype(float)})

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((CLASSES, HISTORIES, HISTORIES))
        for batch in batches:
            for row in batch.itertuples():
                kinds, c, cells, times, _ = shard_words(row, classes)
                total += word_sums(kinds, c, word_weights(kinds, c, cells, times, tables))
        total = total.ravel()
        used = np.flatnonzero(total)
        yield pd.DataFrame({"cell": used, "n": total[used]})

    table = "cell int, n double"
    counts = _cells(block_rows(staged).mapInPandas(seen, table))
    told = words.select("hashes", "endings", "c", "cells", "times")
    tables: list[np.ndarray] = []
    while True:
        total = _cells(told.mapInPandas(sums, table)) + 1
        if len(tables) == WORD_ROUNDS:
            return tables, np.log(total)
        tables = [*tables, counts / total]


class Block:
    """A block row: hash, position and class of every token, and what ``blocks`` wrote.
    With ``turn``, only of the learned texts of that round."""

    def __init__(self, row, classes: Classes, turn: int | None = None):
        self.lengths = _unpacked(row.lengths, np.int64)
        self.held = np.frombuffer(row.held, bool)
        self.words = _unpacked(row.words, np.int32)
        if turn is not None:
            mine = ~self.held & (np.arange(len(self.held)) % ROUNDS == turn)
            self.words = self.words[np.repeat(mine, self.lengths)]
            self.lengths, self.held = self.lengths[mine], self.held[mine]
        known = np.frombuffer(row.hashes, np.uint32)
        self.hashes = known[self.words]
        self.kinds = classes.of(known, np.frombuffer(row.endings, np.uint8)).astype(np.int32)[self.words]
        self.at = positions(self.lengths)


def block_rows(staged: DataFrame) -> DataFrame:
    return staged.where("words is not null").select(*[f.split(" ")[0] for f in BLOCK_FIELDS.split(", ")])


def train(staged: DataFrame, classes: Classes) -> Weights:
    """Weights of groups and classes after ROUNDS rounds over all training texts.

    A round takes every ROUNDS-th document of each block. A task sends the rows it
    changed, in 255 steps of their largest change, with the number of its words that used
    them; their weighted means make the next round's weights. The table has a fixed size; what is sent grows
    with the number of tasks.
    """
    spark = staged.sparkSession
    totals = classes.total
    weights = Weights(totals).both()
    for r in range(ROUNDS):
        start = spark.sparkContext.broadcast(weights)

        def work(batches: Iterator[pd.DataFrame], start=start, r=r) -> Iterator[pd.DataFrame]:
            own, squares = Weights(totals, start.value), Weights(totals)
            uses = np.zeros(BUCKETS, np.int64)
            for batch in batches:
                for row in batch.itertuples():
                    block = Block(row, classes, r)
                    for first in range(0, len(block.words), 64 * BATCH):
                        part = slice(first, first + 64 * BATCH)
                        uses += learn(own, squares, block.hashes[part], block.at[part], block.kinds[part])
            change = own.both() - start.value
            for first in range(0, BUCKETS, ROWS):
                part = slice(first, first + ROWS)
                if uses[part].any():
                    scale = max(float(np.abs(change[part]).max()), 1e-9) / 127
                    steps = np.rint(change[part] / scale).astype(np.int8)
                    yield pd.DataFrame(
                        {"first": [first], "uses": [_packed(uses[part])], "scale": [scale], "change": [_packed(steps)]}
                    )

        def mean(group: pd.DataFrame) -> pd.DataFrame:
            uses, change = np.zeros(ROWS, np.int64), np.zeros((ROWS, GROUPS + CLASSES))
            for row in group.itertuples():
                n = _unpacked(row.uses, np.int64)
                uses += n
                change += n[:, None] * (row.scale * _unpacked(row.change, np.int8).reshape(change.shape))
            change /= np.maximum(uses, 1)[:, None]
            return pd.DataFrame({"first": group["first"][:1], "change": [change.astype(np.float32).tobytes()]})

        sent = block_rows(staged).mapInPandas(work, "first int, uses binary, scale double, change binary")
        means = sent.groupBy("first").applyInPandas(mean, "first int, change binary")
        for row in means.collect():
            part = slice(row["first"], row["first"] + ROWS)
            weights[part] += np.frombuffer(row.change, np.float32).reshape(ROWS, GROUPS + CLASSES)
        start.unpersist()
    return Weights(totals, weights)


def explain(words: DataFrame, classes: Classes, tables: list[np.ndarray]) -> DataFrame:
    """For each block, what every shard knows of its words: count and weights (``cells``:
    place in the part times SIDES plus bucket)."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                kinds, c, cells, times, order = shard_words(row, classes)
                flat = word_weights(kinds, c, cells, times, tables).reshape(-1)
                counts = _unpacked(row.c, np.int64)
                rank = np.full(len(counts), -1, np.int64)
                rank[order] = np.arange(len(order))
                cells = np.sort(cells)
                bounds = np.searchsorted(cells // SIDES, np.arange(len(order) + 1))
                out = []
                for block, numbers, places in zip(row.blocks, row.numbers, row.places, strict=True):
                    place = _unpacked(places, np.int32)
                    known = np.flatnonzero(rank[place] >= 0)
                    of = rank[place[known]]
                    sizes = bounds[of + 1] - bounds[of]
                    at = cells[np.repeat(bounds[of], sizes) + positions(sizes)]
                    own = _steps(np.repeat(known * SIDES, sizes) + at % SIDES)
                    out.append((block, bytes(numbers), _packed(counts[place]), own, _packed(flat[at].astype(np.float16))))
                yield pd.DataFrame(out, columns=["block", "numbers", "c", "cells", "weights"])

    return words.drop("shard", "leaders").mapInPandas(told, "block long, numbers binary, c binary, cells binary, weights binary")


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    ``held_out`` says which rows are not learned from (null: learned from). Scores are
    log10 probabilities of whole texts, their end included. A null text is empty: one
    token. Very long texts are blocks of their own. Repeated rows count and are scored
    each. With nothing to learn from, counts are zero and every known-word figure
    follows from that; an empty table gives no rows. Other columns are not read.
    """
    staged = blocks(docs, id_col, text_col, held_out)
    words = dictionary(staged)
    classes = count_classes(words)
    tokens, distinct = int(classes.total.sum()), int(classes.distinct.sum())
    tables, sums = learn_words(staged, words, classes)
    shared = docs.sparkSession.sparkContext.broadcast((train(staged, classes), sums))
    lowest = math.log10(tokens + distinct + 1)

    def score(batch: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        weights, sums = shared.value
        out = []
        for row in batch.itertuples():
            block = Block(row, classes)
            size = len(row.hashes) // 4
            count = np.zeros(size, np.int64)
            own = np.zeros((size, SIDES), np.float16)
            for part in dictionary.itertuples():
                number = _from_steps(part.numbers)
                count[number] = _unpacked(part.c, np.int64)
                cells = _from_steps(part.cells)
                own[number[cells // SIDES], cells % SIDES] = _unpacked(part.weights, np.float16)
            base = np.log10(count + 1) - lowest
            share = np.log(count + 1)
            end = 0
            # Texts in runs, so that what is worked out per token stays small.
            for first, last in runs(block.lengths, 64 * BATCH):
                part = slice(end, end := end + int(block.lengths[first:last].sum()))
                w, hashes, at, kinds = block.words[part], block.hashes[part], block.at[part], block.kinds[part]
                g, h = histories(hashes, at)
                inside = share[w] + own[w, g] + own[w, HISTORIES + h] - sums[kinds, g, h]
                full = class_log10(weights, hashes, at, kinds) + inside / math.log(10)
                starts = np.cumsum(block.lengths[first:last]) - block.lengths[first:last]
                found = [np.add.reduceat(x, starts) for x in ((count[w] > 0).astype(np.int64), base[w], full)]
                for k, (known, plain, score) in enumerate(zip(*found, strict=True), first):
                    out.append((row.ids[k]["id"], bool(block.held[k]), int(block.lengths[k]), int(known), tokens, float(plain), float(score)))
        return pd.DataFrame(out, columns=names, dtype=object)

    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    coded = staged.where("words is not null").select("block", "ids", *[f.split(" ")[0] for f in BLOCK_FIELDS.split(", ")])
    told = explain(words, classes, tables)
    return coded.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(score, schema)


def runs(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` tokens; a longer text is a run of its own."""
    first, size = 0, 0
    for k, n in enumerate(lengths):
        if size and size + n > limit:
            yield first, k
            first, size = k, 0
        size += n
    if size:
        yield first, len(lengths)
