"""Ranked search over bit-sliced Bloom signatures, exact in its results.

Every document has a Bloom signature of its terms; documents of like size form a block
whose signatures are stored by bit position, as one bitmap over the block's documents.
The bitmaps of a term, combined, hold all documents that have it and some that do not.
Weighted sums of them over a query's terms are upper bounds of the documents' scores.
Documents whose bound is below the tenth best score met so far are excluded; all
others are scored exactly from their text.

A term that occurs often in a document enters its signature once more at each of a
few frequencies, so that a bound need not assume the highest frequency everywhere.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.textrules import alnum_words
from feedlake.session import materialize

TOP = 10
#: Frequencies from which a term is entered again.
LEVELS = (1, 2, 4, 8)
BITS_PER_TERM = 16
PROBES = 4
LEAST_WIDTH, MOST_WIDTH = 1 << 6, 1 << 20
#: A block is closed at so many documents, bytes of text, or signature bits.
BLOCK_DOCS = 512
BLOCK_BYTES = 4 << 20
BLOCK_BITS = 1 << 24
#: Distinct terms a task counts before it hands them on.
HELD_TERMS = 200_000
#: Blocks that are searched first, to know how good the best are at least.
FLOOR_BLOCKS = 32
#: Queries are searched in groups of about so many (query, term) pairs, a job for each.
GROUP_PAIRS = 1 << 16
#: Cells of a query group by documents that are summed at a time.
CELLS = 1 << 22

K_SCALE, LENGTH_SHARE = 8, 90


def entries(hashes: np.ndarray, level: int) -> np.ndarray:
    """What a term's hash becomes at a frequency level; two probes are cut from it."""
    mixed = (hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return mixed ^ (mixed >> np.uint64(28))


def probes(mixed: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The bits of an entry, by double hashing."""
    at, step = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32) | np.uint64(1)
    for _ in range(PROBES):
        yield (at & np.uint64(width - 1)).astype(np.int64)
        at = at + step


def term_hashes(terms: Iterable[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms), np.uint64, count)


class _Block:
    """Documents of one size class that wait to be written."""

    def __init__(self, width: int):
        self.width, self.docs, self.size = width, [], 0

    def add(self, doc_id, text: str, counts: Counter) -> None:
        times = np.fromiter(counts.values(), np.int64, len(counts))
        self.docs.append((doc_id, counts.total(), text, term_hashes(counts, len(counts)), times))
        self.size += len(text)

    def full(self) -> bool:
        return (
            len(self.docs) >= BLOCK_DOCS or self.size >= BLOCK_BYTES or (len(self.docs) + 8) * self.width > BLOCK_BITS
        )

    def row(self) -> dict:
        bits = np.zeros((self.width, -(-len(self.docs) // 8) * 8), bool)
        ids, lengths, texts, hashed, counted = zip(*self.docs, strict=True)
        owner = np.repeat(np.arange(len(ids)), [len(h) for h in hashed])
        hashes, times = np.concatenate(hashed), np.concatenate(counted)
        for k, least in enumerate(LEVELS):
            often = times >= least
            for probe in probes(entries(hashes[often], k), self.width):
                bits[probe, owner[often]] = True
        self.docs, self.size = [], 0
        return {
            "ids": list(ids), "lengths": list(lengths), "texts": list(texts), "width": self.width,
            "slices": np.packbits(bits, axis=1).tobytes(), "term": None, "df": None,
        }


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: a table of blocks (ids, lengths, texts, width, slices) and, in other rows
    of it, (term, df) counts of tasks, to be summed by term.

    A row per document with a term is in one block, repeated rows included. Each task
    indexes its own rows; nothing is shuffled. A signature of more than MOST_WIDTH bits is
    cut to that width: it excludes less, but loses nothing.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, blocks, schema = Counter(), {}, None

        def terms() -> pa.RecordBatch:
            n = len(frequency)
            columns = {
                "ids": pa.nulls(n, schema.field("ids").type), "lengths": pa.nulls(n, pa.list_(pa.int64())),
                "texts": pa.nulls(n, pa.list_(pa.string())), "width": pa.nulls(n, pa.int32()),
                "slices": pa.nulls(n, pa.binary()),
                "term": pa.array([t.decode() for t in frequency], pa.string()), "df": pa.array(list(frequency.values()), pa.int64()),
            }
            frequency.clear()
            return pa.RecordBatch.from_pydict(columns, schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema(
                    [
                        ("ids", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int64())),
                        ("texts", pa.list_(pa.string())), ("width", pa.int32()), ("slices", pa.binary()),
                        ("term", pa.string()), ("df", pa.int64()),
                    ]
                )
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                counts = Counter(alnum_words(text))
                if not counts:
                    continue
                frequency.update(counts.keys())
                width = 1 << (BITS_PER_TERM * len(counts) - 1).bit_length()
                width = min(max(width, LEAST_WIDTH), MOST_WIDTH)
                block = blocks.setdefault(width, _Block(width))
                block.add(doc_id.as_py(), text, counts)
                if block.full():
                    yield pa.RecordBatch.from_pylist([block.row()], schema)
                if len(frequency) > HELD_TERMS:
                    yield terms()
        for block in blocks.values():
            if block.docs:
                yield pa.RecordBatch.from_pylist([block.row()], schema)
        if frequency:
            yield terms()

    schema = (
        f"ids array<{kind}>, lengths array<long>, texts array<string>, width int, slices binary, term string, df long"
    )
    return materialize(rows.mapInArrow(index, schema), "search-index")


@dataclass
class Group:
    """Queries that are searched together. ``flat``: their terms one after another, as
    places in ``terms``; query k has those from starts[k] on."""

    keys: list[int]
    terms: dict[bytes, int]
    weights: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    n_docs: int
    n_terms: int
    floors: np.ndarray

    def length_norm(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * self.n_docs) // self.n_terms

    def part(self, times: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """What a term of weight 1 adds to a score."""
        return (1_000_000_000 * times) // (1000 * times + K_SCALE * norm)


def best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows (key, id, score) of each query, with their rank."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def bounds(group: Group, mixed: list[np.ndarray], lengths: np.ndarray, width: int, slices: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of a block's documents (query, document)."""
    count = len(lengths)
    norm = group.length_norm(lengths)
    weight = group.weights[group.flat].astype(np.float32)[:, None]
    owner = np.repeat(np.arange(len(group.starts)), np.diff(group.starts, append=len(group.flat)))
    out = np.zeros((len(group.starts), count), np.float64)
    # Terms that no document of the block may have at a level are left out from there on.
    rows, present, before = np.arange(len(owner)), None, np.zeros(count)
    for k in range(len(LEVELS)):
        # Frequencies from this level up to the next; from the last one up to the length.
        most = np.minimum(lengths, LEVELS[k + 1] - 1) if k + 1 < len(LEVELS) else lengths
        gain = group.part(most, norm) + 1.0
        for probe in probes(mixed[k][rows], width):
            present = slices[probe] if present is None else present & slices[probe]
        some = present.any(axis=1)
        rows, present = rows[some], present[some]
        if not len(rows):
            break
        first = np.flatnonzero(np.diff(owner[rows], prepend=-1))
        step = max(8, CELLS // len(rows) // 8 * 8)
        for at in range(0, count, step):
            cells = np.unpackbits(present[:, at // 8 : (at + step) // 8], axis=1)[:, : count - at]
            sums = np.add.reduceat(cells * weight[rows], first, axis=0)
            out[owner[rows[first]], at : at + step] += sums * (gain - before)[at : at + step]
        before = gain
    # Sums of floats may be a little low.
    return out * (1 + 1e-4)


def search_blocks(index: DataFrame, group: Broadcast, top: int) -> DataFrame:
    """(key, id, score): the best of each task for every query of the group. A query
    starts from its group's floor, below which a score can't be among the best."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Group = group.value
        names = list(q.terms)
        hashes = term_hashes(names, len(names))
        mixed = [entries(hashes, k)[q.flat] for k in range(len(LEVELS))]
        tops: list[list[tuple[int, bool, object]]] = [[] for _ in q.keys]
        least = q.floors.copy()

        def take(scores: np.ndarray, doc_id) -> None:
            for k in np.flatnonzero((scores > 0) & (scores >= least)):
                mine = tops[k]
                mine.append((-int(scores[k]), doc_id is None, doc_id))
                if len(mine) > top:
                    mine.sort(key=lambda x: x if x[2] is not None else (x[0], True, 0))
                    del mine[top:]
                if len(mine) == top:
                    least[k] = max(least[k], -max(x[0] for x in mine))

        for batch in batches:
            for block in batch.to_pylist():
                lengths = np.array(block["lengths"], np.int64)
                slices = np.frombuffer(block["slices"], np.uint8).reshape(block["width"], -1)
                bound = bounds(q, mixed, lengths, block["width"], slices)
                norm = q.length_norm(lengths)
                # The most promising first, so that the thresholds rise early.
                for d in np.argsort(-bound.max(axis=0), kind="stable"):
                    if not ((bound[:, d] > 0) & (bound[:, d] >= least)).any():
                        continue
                    counts = Counter(alnum_words(block["texts"][d]))
                    met = [(q.terms[t], n) for t, n in counts.items() if t in q.terms]
                    if not met:
                        continue
                    at, times = np.array(met, np.int64).T
                    parts = np.zeros(len(names), np.int64)
                    parts[at] = q.weights[at] * q.part(times, norm[d])
                    take(np.add.reduceat(parts[q.flat], q.starts), block["ids"][d])
        for k, mine in enumerate(tops):
            if mine:
                ids = pa.array([x[2] for x in mine], kinds)
                keys, scores = pa.array([q.keys[k]] * len(mine), pa.int64()), pa.array([-x[0] for x in mine], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, ids, scores], ["key", "id", "score"])

    kinds = _arrow_type(index)
    blocks = index.where("width is not null").select("ids", "lengths", "texts", "width", "slices")
    return blocks.mapInArrow(search, f"key long, id {kind}, score long")


def _arrow_type(index: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(index.schema["ids"].dataType.elementType)


def floors(index: DataFrame, group: Group, n_blocks: int, top: int) -> np.ndarray:
    """Scores that each query's best documents reach at least: those of the best in some
    FLOOR_BLOCKS blocks. A query without so many documents there starts from 0."""
    few = F.pmod(F.xxhash64("width", F.col("ids")[0]), F.lit(max(1, n_blocks // FLOOR_BLOCKS))) == 0
    shipped = index.sparkSession.sparkContext.broadcast(group)
    last = best(search_blocks(index.where(few), shipped, top), top).where(F.col("rank") == top)
    known = {row.key: row.score for row in last.select("key", "score").collect()}
    return np.array([float(known.get(key, 0)) for key in group.keys])


def groups(
    index: DataFrame, queries: DataFrame, n_docs: int, n_terms: int
) -> Iterator[tuple[Group, DataFrame]]:
    """The queries (key, item, terms) in groups of bounded size, ready to be searched, with
    their (key, item) rows."""
    pairs = queries.select("key", F.explode("terms").alias("term"))
    counted = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    pairs = materialize(pairs.join(counted, "term"), "query-terms")
    count = max(1, -(-pairs.count() // GROUP_PAIRS))
    for k in range(count):
        mine = F.pmod(F.xxhash64("key"), F.lit(count)) == k
        rows = pairs.where(mine).orderBy("key", "term").collect()
        if not rows:
            continue
        terms: dict[bytes, int] = {}
        weights, flat, keys, starts = [], [], [], []
        for row in rows:
            term = row.term.encode()
            if term not in terms:
                terms[term] = len(terms)
                weights.append(term_weight(n_docs, row.df))
            if not keys or keys[-1] != row.key:
                keys.append(row.key)
                starts.append(len(flat))
            flat.append(terms[term])
        group = Group(keys, terms, np.array(weights, np.int64), np.array(flat), np.array(starts), n_docs, n_terms, np.zeros(len(keys)))
        yield group, queries.where(mine).select("key", "item")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item, rank, id, score): the ``top`` best documents of every row of ``items``.

    Only scores above 0 count; equal scores are ordered by id, null ids last. Null and
    empty texts have no terms and are neither found nor search for anything; texts of any
    length count whole. Rows of ``docs`` that repeat are found as often; rows of ``items``
    that repeat an id are searched for each. An empty table gives an empty result. Other
    columns are not read.

    The index holds every document. Tasks search their own blocks and return at most
    ``top`` rows for each query; queries go to the tasks in groups of bounded size.
    """
    spark = docs.sparkSession
    index = build(docs, id_col, text_col)
    blocks = index.where("width is not null")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    n_blocks, n_docs, n_terms = blocks.agg(F.count("*"), F.sum(F.size("ids")), F.sum(total)).first()

    @F.pandas_udf("array<string>")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({w.decode() for w in alnum_words(t)}))

    asked = items.select(F.col(item_col).alias("item"), distinct_terms(F.col(item_text_col)).alias("terms"))
    asked = materialize(asked.withColumn("key", F.monotonically_increasing_id()), "queries")
    found = None
    for group, named in groups(index, asked, n_docs, n_terms) if n_docs else ():
        group.floors = floors(index, group, n_blocks, top)
        mine = search_blocks(index, spark.sparkContext.broadcast(group), top).join(named, "key")
        found = mine if found is None else found.unionByName(mine)
    if found is None:
        kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, id_col), (items, item_col)))
        return spark.createDataFrame([], f"item {item_kind}, rank int, id {kind}, score long")
    return best(found, top).select("item", "rank", "id", "score")
