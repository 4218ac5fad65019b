"""All pairs of like sets, with little moved: sets are stored once, ordered where they lie,
and go to other tasks only with a partner to be compared with.

Sets are rows of distinct numbers from 0 to 2^31 - 2, ascending (``s array<int>``), ``n`` their
size, at least 1. Two sets with a Jaccard similarity of ``percent`` hundredths share one of
their rarest numbers (prefix filter), early enough in that order (positional filter), and
differ little in size; the pairs left are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.session import materialize

#: Numbers share counters of fixed size, and ties are broken by number. Any common order
#: finds every pair; a finer one gives fewer pairs to compare.
COUNTERS = 1 << 23
#: Counts from here on are ordered alike.
_MOST = 0xFFFF
_PART = 1 << 13
#: Numbers that are put in order together, on average.
_SLICE = 1 << 20
#: Numbers and sets of a block, and pairs or numbers of a group of tiles, on average.
BLOCK = 1 << 17
MEMBERS = 1 << 9
GROUP = 1 << 16
#: No number of a set, but fits 31 bits.
_NONE = 0x7FFFFFFF


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, list lengths, list values) of column ``s``, in pieces of about _SLICE values."""
    for batch in batches:
        at = batch.schema.get_field_index("s")
        ends = np.cumsum(batch.column(at).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            stop = min(max(first + 1, int(np.searchsorted(ends, before + _SLICE, "right"))), first + (1 << 17))
            piece = batch.slice(first, stop - first)
            yield piece, np.diff(ends[first:stop], prepend=before), piece.column(at).flatten().to_numpy()
            first = stop


def counted(rows: DataFrame) -> Broadcast:
    """How many numbers of ``s`` fall to each counter: an array of fixed size that tasks hold.

    A task counts what one core reads, so that few tables cross the network."""
    spark = rows.sparkSession
    size, part = COUNTERS, min(COUNTERS, _PART)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for _, _, values in _pieces(batches):
            # A number that is there twice would be counted once by plain indexing.
            np.add.at(total, (values & (size - 1)).astype(np.intp), np.int32(1))
        for first in np.flatnonzero(total.reshape(-1, part).any(axis=1)) * part:
            n = np.minimum(total[first : first + part], _MOST).astype(np.uint16)
            packed = pa.compress(n.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int32()), "n": pa.array([packed], pa.binary())})

    def unpacked(n: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(n, part * 2, codec="zstd", asbytes=True), np.uint16)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpacked(n).astype(np.int64) for n in group["n"])
        packed = pa.compress(np.minimum(total, _MOST).astype(np.uint16).tobytes(), codec="zstd", asbytes=True)
        return pd.DataFrame({"first": group["first"][:1], "n": [packed]})

    table = np.zeros(size, np.uint16)
    read = rows.select("s").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(count, "first int, n binary")
    for row in read.groupBy("first").applyInPandas(add, "first int, n binary").collect():
        table[row["first"] : row["first"] + part] = unpacked(row["n"])
    return spark.sparkContext.broadcast(table)


def rarest(sets: DataFrame, counts: Broadcast, percent: int) -> DataFrame:
    """(doc_id, n, p): the numbers, rarest first, of which a like set must share one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for rows, n, values in _pieces(batches):
            # One number to sort by: 17 bits for the set, 16 for the count, 31 for the number.
            order = np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(47), n)
            order |= table[(values & (len(table) - 1)).astype(np.intp)].astype(np.uint64) << np.uint64(31)
            order = np.sort(order | values.astype(np.uint64))
            length = n + -n * percent // 100 + 1
            early = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(length, n)
            kept = pa.array((order[early] & np.uint64(_NONE)).astype(np.int32))
            ends = pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32))
            columns = [rows.column(0), rows.column(1), pa.ListArray.from_arrays(ends, kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "p"])

    schema = T.StructType([sets.schema["doc_id"], *T.StructType.fromDDL("n int, p array<int>").fields])
    return sets.select("doc_id", "n", "s").mapInArrow(cut, schema)


def met(prefixes: DataFrame, percent: int) -> DataFrame:
    """(doc_id, other), other < doc_id: sets that may be alike. ``prefixes``: see :func:`rarest`.

    Sets that share a number and also the one ahead of it have met there, so a pair comes
    once for each run of shared numbers and not for each of them."""
    high = lambda upper, lower: F.shiftleft(upper.cast("long"), 32).bitwiseOR(lower.cast("long"))
    ahead = lambda i: F.coalesce(F.get("p", i - 1), F.lit(_NONE))
    # Two narrow columns hold place and number, size and number ahead: most of these rows meet no other.
    places = F.transform("p", lambda h, i: F.struct(high(i, h).alias("place"), high(F.col("n"), ahead(i)).alias("ahead")))
    rows = prefixes.select("doc_id", F.explode(places).alias("x")).select("x.place", "x.ahead", "doc_id")
    a, b = (rows.select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns)) for side in "ab")

    def upper(column: str):
        return F.shiftright(column, 32)

    def lower(column: str):
        return F.col(column).bitwiseAND(F.lit(_NONE).cast("long"))

    a_n, b_n = upper("a_ahead"), upper("b_ahead")
    rest = F.least(a_n - upper("a_place"), b_n - upper("b_place"))
    fits = (F.least(a_n, b_n) * 100 >= F.greatest(a_n, b_n) * percent) & (rest * (100 + percent) >= (a_n + b_n) * percent)
    first = (upper("a_place") == 0) | (lower("a_ahead") != lower("b_ahead"))
    both = a.join(b, lower("a_place") == lower("b_place")).filter((F.col("b_doc_id") < F.col("a_doc_id")) & fits & first)
    return both.select(F.col("a_doc_id").alias("doc_id"), F.col("b_doc_id").alias("other"))


def _tiled(found: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with the group of tiles they are compared in, and the sets (doc_id) in pairs.

    Sets whose earliest partner is the same are cut into blocks of bounded size,
    and a tile is a pair of blocks: a family of like sets is moved once for each of its
    blocks, not for each pair."""
    first = found.groupBy("doc_id").agg(F.min("other").alias("root"))
    paired = found.select(F.explode(F.array("doc_id", "other")).alias("doc_id")).distinct()
    members = paired.join(first, "doc_id", "left").join(sizes.groupBy("doc_id").agg(F.sum("n").alias("n")), "doc_id")
    members = members.select("doc_id", F.coalesce("root", "doc_id").alias("root"), "n")
    members = materialize(members, "members")
    parts = F.greatest(F.sum("n") / BLOCK, F.count(F.lit(1)) / MEMBERS)
    roots = members.groupBy("root").agg(F.ceil(parts).alias("blocks"))
    blocks = members.join(roots, "root").select(
        "doc_id", F.xxhash64("root", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).alias("block")
    )
    blocks = materialize(blocks, "blocks")
    numbers = members.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    groups = 1 + F.greatest(numbers, found.select(F.count(F.lit(1))).scalar()) / GROUP
    tiled = found.join(blocks.withColumnRenamed("block", "a"), "doc_id").join(
        blocks.select(F.col("doc_id").alias("other"), F.col("block").alias("b")), "other"
    )
    tile = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), groups.cast("long"))
    return materialize(tiled.select("doc_id", "other", tile.alias("tile")), "tiles"), blocks.select("doc_id")


def _sketches(n: np.ndarray, values: np.ndarray) -> pa.Array:
    """A bit for each remainder of a set's numbers, set if an odd count has it; a power of two bits,
    as many as numbers or more. Two sets differ in no fewer numbers than their sketches in bits."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(n)).astype(np.int64))
    ends = np.cumsum(bits)
    at = np.repeat(ends - bits, n) + (values & (np.repeat(bits, n) - 1))
    odd = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(bool))
    ends = pa.array(np.concatenate(([0], ends // 8)).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(odd)])


def _kept(sets: DataFrame, wanted: Broadcast, sketched: bool) -> DataFrame:
    """(doc_id, n, s) of wanted sets, whole or as sketches, and of some others that share their counters."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for batch in batches:
            batch = batch.filter(pa.array(table[batch.column(3).to_numpy() & (len(table) - 1)] > 0)).select([0, 1, 2])
            if not sketched:
                yield batch
                continue
            for rows, n, values in _pieces([batch]):
                columns = [rows.column(0), rows.column(1), _sketches(n, values)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s"])

    rows = sets.select("doc_id", "n", "s", F.xxhash64("doc_id").alias("mark"))
    kept = T.StructField("s", T.BinaryType()) if sketched else sets.schema["s"]
    return rows.mapInArrow(keep, T.StructType([sets.schema["doc_id"], sets.schema["n"], kept]))


def _compared(sets: DataFrame, found: DataFrame, sketched: bool, compare, schema: str) -> DataFrame:
    """What ``compare`` finds in the pairs and the sets, or sketches, of each group of tiles;
    ``schema``: its columns behind doc_id and other."""
    tiled, wanted = _tiled(found, sets.select("doc_id", "n"))
    marks = counted(wanted.select(F.array(F.xxhash64("doc_id")).alias("s")))
    sent = tiled.select(F.explode(F.array("doc_id", "other")).alias("doc_id"), F.col("tile").alias("to")).distinct()
    moved = _kept(sets, marks, sketched).join(sent, "doc_id")
    fields = [*found.select("doc_id", "other").schema, *T.StructType.fromDDL(schema)] if schema else found.schema.fields
    return tiled.groupBy("tile").cogroup(moved.groupBy("to")).applyInArrow(compare, T.StructType(fields))


def _joined(pairs: pa.Table, sets: pa.Table) -> pd.DataFrame:
    """(doc_id, other, a, b): pairs with the places of their sets, in order of the first."""
    rows = pd.DataFrame({"doc_id": sets.column("doc_id").to_pandas(), "row": np.arange(len(sets))})
    joined = pairs.select(["doc_id", "other"]).to_pandas().merge(rows.rename(columns={"row": "a"}), on="doc_id")
    return joined.merge(rows.rename(columns={"doc_id": "other", "row": "b"}), on="other").sort_values("a", kind="stable")


def sifted(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``found`` without those whose sketches show that they are not alike; arguments as of :func:`likest`."""

    def compare(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        sketches = sets.column("s").combine_chunks()
        size = np.diff(np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1])
        n = sets.column("n").to_numpy().astype(np.int64)
        met = _joined(pairs, sets)
        a, b = met["a"].to_numpy(), met["b"].to_numpy()
        place, words = np.zeros(len(n), np.int64), {}
        for k in np.unique(size):
            of = np.flatnonzero(size == k)
            place[of] = np.arange(len(of))
            words[k] = np.frombuffer(b"".join(sketches.take(pa.array(of)).to_pylist()), np.uint64).reshape(len(of), -1)
        kept = np.zeros(len(met), bool)
        kinds = size[a].astype(np.int64) << 32 | size[b]
        for kind in np.unique(kinds):
            both = np.flatnonzero(kinds == kind)
            x, y = words[kind >> 32], words[kind & 0xFFFFFFFF]
            least = min(x.shape[1], y.shape[1])
            # A sketch of fewer bits is made of the halves of a longer one.
            while x.shape[1] > least:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > least:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            for k in np.array_split(both, -(-len(both) * least // _SLICE)):
                differ = np.bitwise_count(x[place[a[k]]] ^ y[place[b[k]]]).sum(axis=1, dtype=np.int64)
                kept[k] = differ * (100 + percent) <= (n[a[k]] + n[b[k]]) * (100 - percent)
        left = met.loc[kept, ["doc_id", "other"]].drop_duplicates()
        return pa.Table.from_arrays([pa.array(left[c], pairs.schema.field(c).type) for c in left], ["doc_id", "other"])

    return _compared(sets, found, True, compare, "")


def likest(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(doc_id, other, common, total): the pairs of ``found`` at the threshold, with the size of
    the intersection and the sum of both sizes. Of a set's pairs those much below its best one
    in their group of tiles (by over two millionths) are left out.

    ``sets``: doc_id, n, s; ``found``: doc_id, other; stored, for both are read more than once."""

    def compare(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        lists = sets.column("s").combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(n) - n
        numbers, values = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        met = _joined(pairs, sets)
        a, b = met["a"].to_numpy(), met["b"].to_numpy()
        common, kept = np.zeros(len(met), np.int64), np.zeros(len(met), bool)
        held = np.zeros(len(numbers), bool)
        bounds = np.flatnonzero(np.diff(a, prepend=-1, append=-1)) if len(a) else []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            own = values[start[a[low]] : start[a[low]] + n[a[low]]]
            held[own] = True
            # The partners are taken a slice at a time, for one set may have very many.
            sizes = n[b[low:high]]
            for k in np.split(np.arange(low, high), np.flatnonzero(np.diff(np.cumsum(sizes) // _SLICE)) + 1):
                ends = np.cumsum(n[b[k]])
                at = np.arange(ends[-1]) + np.repeat(start[b[k]] - ends + n[b[k]], n[b[k]])
                common[k] = np.add.reduceat(held[values[at]], ends - n[b[k]], dtype=np.int64)
            held[own] = False
            union = n[a[low]] + sizes - common[low:high]
            share = common[low:high] / union
            kept[low:high] = (common[low:high] * 100 >= union * percent) & (share >= share.max() - 2e-6)
        columns = [met["doc_id"], met["other"], common, n[a] + n[b]]
        return pa.Table.from_arrays(
            [pa.array(np.asarray(c)[kept], f.type) for c, f in zip(columns, [*pairs.schema][:2] + [pa.field("", pa.int64())] * 2, strict=True)],
            ["doc_id", "other", "common", "total"],
        )

    return _compared(sets, found, False, compare, "common long, total long")
