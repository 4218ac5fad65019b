"""Near duplicates of new documents among all that came before, without reading old texts.

The index keeps the shingle sets of documents that were not copies, and for each the
rarest of its shingles with their places (its prefix). Rarity is counted once, over the
first run, and stays: every run must order its shingles alike, and any common order finds
every pair. :meth:`ShingleIndex.rebuild` counts it again over all that is stored.

Rarity is a table of fixed size that every task holds, so that a set is ordered where it
lies: its shingles cross no network, only those of its prefix do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import config as C
from feedlake.functions.text import settled
from feedlake.operators.insights import shingle_set
from feedlake.session import materialize
from feedlake.sinks.index import partition_folders

_SETS = "doc_id long, key string, n int, s array<bigint>, run string"
_PREFIXES = "h long, doc_id long, n int, at int, run string"
_ORDER = "first int, n binary"
_LINKS = "doc_id long, duplicate_of long, jaccard double"
#: Shingles share counters, and ties are broken by hash. Any common order gives right
#: results; a finer one gives fewer pairs to verify.
COUNTERS = 1 << 23
#: Counts from here on are ordered alike.
_MOST = 0xFFFF
_PART = 1 << 13
#: Shingles that are put in order together, on average.
_SLICE = 1 << 20


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """(rows, list lengths, list values): batches in pieces of about _SLICE values."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(batch.column(at).value_lengths().to_numpy(zero_copy_only=False))
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(ends, before + _SLICE, "right")))
            piece = batch.slice(first, stop - first)
            yield piece, np.diff(ends[first:stop], prepend=before), piece.column(at).flatten()
            first = stop


def _count(sets: DataFrame) -> DataFrame:
    """(first, n): how many sets have a shingle of each counter, in parts of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int32)
        for _, _, values in _pieces(batches, "s"):
            # A number that is there twice would be counted once by plain indexing.
            np.add.at(total, values.to_numpy() & (COUNTERS - 1), 1)
        for first in range(0, COUNTERS, _PART):
            used = np.flatnonzero(total[first : first + _PART])
            if len(used):
                n = np.minimum(total[first + used], _MOST).astype(np.uint16)
                yield pa.RecordBatch.from_pydict(
                    {"first": pa.array([first], pa.int32()), "at": [used.astype(np.uint16).tobytes()], "n": [n.tobytes()]}
                )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_PART, np.int64)
        for at, n in zip(group["at"], group["n"], strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint16)
        return pd.DataFrame({"first": group["first"][:1], "n": [np.minimum(total, _MOST).astype(np.uint16).tobytes()]})

    counted = sets.select("s").mapInArrow(count, "first int, at binary, n binary")
    return counted.groupBy("first").applyInPandas(add, _ORDER)


class ShingleIndex:
    """The index below ``path``.

    ``generation=<g>/`` holds order/, sets/ and prefixes/ by run, and what a rebuild
    merged; the highest finished generation counts. links/ has the result of each run.
    """

    def __init__(self, spark: SparkSession, path: str, settings: C.NearDuplicateSettings = C.NearDuplicateSettings()):
        self.spark, self.path, self.settings = spark, path, settings

    def _generation(self) -> int | None:
        found = partition_folders(self.spark, f"{self.path}/finished", "generation")
        return max(map(int, found), default=None)

    def _finish(self, generation: int) -> None:
        mark = self.spark.range(1).select(F.lit(generation).alias("number"))
        mark.write.mode("overwrite").json(f"{self.path}/finished/generation={generation}")

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation={generation}"

    def _runs(self, table: str, schema: str, before: str | None) -> DataFrame:
        """Rows of runs ahead of ``before``: those a rebuild merged and those written since."""
        generation = self._generation()
        full = T.StructType.fromDDL(schema)
        rows = self.spark.createDataFrame([], full)
        if generation is not None:
            folder = self._folder(generation)
            if partition_folders(self.spark, f"{folder}/{table}", "run"):
                rows = self.spark.read.schema(full).parquet(f"{folder}/{table}")
            if generation > 0:
                rows = rows.unionByName(self.spark.read.schema(full).parquet(f"{folder}/merged_{table}"))
        return rows if before is None else rows.where(F.col("run") < before)

    def _freeze(self, sets: DataFrame, generation: int) -> None:
        """Store how many sets have the shingles of each counter."""
        _count(sets).write.mode("overwrite").parquet(f"{self._folder(generation)}/order/counters={COUNTERS}")

    def _order(self, generation: int) -> Broadcast:
        """The frozen counts."""
        folder = f"{self._folder(generation)}/order"
        size = partition_folders(self.spark, folder, "counters")[0]
        table = np.zeros(int(size), np.uint16)
        for row in self.spark.read.schema(_ORDER).parquet(f"{folder}/counters={size}").collect():
            part = np.frombuffer(row["n"], np.uint16)
            table[row["first"] : row["first"] + len(part)] = part
        return self.spark.sparkContext.broadcast(table)

    def _prefixes(self, sets: DataFrame, order: Broadcast) -> DataFrame:
        """(h, doc_id, n, at): the shingles of a set that a similar set must meet one of."""
        percent = self.settings.percent

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = order.value
            for rows, n, flat in _pieces(batches, "s"):
                owner, values = np.repeat(np.arange(len(n)), n), flat.to_numpy()
                values = values[np.lexsort((values, counts[values & (len(counts) - 1)], owner))]
                at = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
                early = at < (n + -n * percent // 100 + 1)[owner]
                owner = pa.array(owner[early])
                columns = [pa.array(values[early]), rows.column(0).take(owner), rows.column(1).take(owner), pa.array(at[early].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "n", "at"])

        return sets.select("doc_id", "n", "s").mapInArrow(cut, "h long, doc_id long, n int, at int")

    def _write(self, sets: DataFrame, prefixes: DataFrame, generation: int, run: str) -> None:
        folder = self._folder(generation)
        sets.write.mode("overwrite").parquet(f"{folder}/sets/run={run}")
        sorted_prefixes = prefixes.repartitionByRange("h").sortWithinPartitions("h")
        sorted_prefixes.write.mode("overwrite").parquet(f"{folder}/prefixes/run={run}")

    def add(self, docs: DataFrame, run: str) -> DataFrame:
        """(doc_id, duplicate_of, jaccard) of a batch; its documents then belong to history.

        ``docs``: doc_id, text. A document meets those of earlier runs and those of its own
        batch with a smaller id; the most similar one at the threshold is reported, of
        equal ones that with the smallest id. Exact copies are linked to the first document
        with their set and are not stored again. A null text is empty, and equal to other
        empty ones; rows without an id are left out; ids are unique. With ids that grow
        from run to run the links of all runs are those of one pass over all documents.
        Runs come in the order of their names; a run done again replaces itself.
        """
        generation = self._generation()
        if generation is not None and not partition_folders(self.spark, f"{self._folder(generation)}/order", "counters"):
            # Ordered by exact counts, as before there were counters: one index has one order.
            generation = self.rebuild()
        s = F.array_sort(shingle_set(F.coalesce("text", F.lit("")), self.settings.shingle_words))
        sets = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), s.alias("s"))
        key = F.sha2(F.array_join(F.col("s").cast("array<string>"), ","), 256)
        sets = materialize(sets.select("doc_id", key.alias("key"), F.size("s").alias("n"), "s"), "batch")

        stored = self._runs("sets", _SETS, run)
        known = stored.join(sets.select("key"), "key", "left_semi").select("key", F.col("doc_id").alias("leader"))
        first = sets.groupBy("key").agg(F.min("doc_id").alias("leader"))
        leaders = materialize(known.unionByName(first.join(known, "key", "left_anti")), "leaders")
        led = sets.select("doc_id", "key").join(leaders, "key").where("doc_id <> leader")
        led = materialize(led, "copies")
        copies = led.select("doc_id", F.col("leader").alias("duplicate_of"), F.lit(1.0).alias("jaccard"))
        # Copies are the fewer rows; the sets stay where they are unless copies are many.
        new = materialize(sets.join(led, ["doc_id", "key"], "left_anti").select("doc_id", "key", "n", "s"), "new")

        if generation is None:
            generation = 0
            self._freeze(new, generation)
            self._finish(generation)
        prefixes = materialize(self._prefixes(new, self._order(generation)), "prefixes")
        self._links(new, prefixes, stored, run).unionByName(copies).write.mode("overwrite").parquet(
            f"{self.path}/links/run={run}"
        )
        self._write(new, prefixes, generation, run)
        return self.spark.read.schema(_LINKS).parquet(f"{self.path}/links/run={run}")

    def _links(self, new: DataFrame, prefixes: DataFrame, stored: DataFrame, run: str) -> DataFrame:
        """Best earlier match of each new set."""
        a = prefixes.select("h", *(F.col(c).alias(f"a_{c}") for c in ("doc_id", "n", "at")))
        old = self._runs("prefixes", _PREFIXES, run).select("h", "doc_id", "n", "at", F.lit(True).alias("old"))
        others = old.unionByName(prefixes.withColumn("old", F.lit(False)))
        b = others.select("h", *(F.col(c).alias(f"b_{c}") for c in ("doc_id", "n", "at", "old")))
        earlier = F.col("b_old") | (F.col("b_doc_id") < F.col("a_doc_id"))
        pairs = a.join(b, "h").where(earlier & self._fits())
        pairs = materialize(pairs.select("a_doc_id", "b_doc_id").distinct(), "pairs")

        wanted = pairs.select(F.col("b_doc_id").alias("doc_id"))
        partners = stored.select("doc_id", "s").unionByName(new.select("doc_id", "s")).join(wanted, "doc_id", "left_semi")
        both = pairs.join(
            new.select(F.col("doc_id").alias("a_doc_id"), F.col("s").alias("a_s")), "a_doc_id"
        ).join(partners.select(F.col("doc_id").alias("b_doc_id"), F.col("s").alias("b_s")), "b_doc_id")
        measured = both.select(
            F.col("a_doc_id").alias("doc_id"),
            F.col("b_doc_id").alias("duplicate_of"),
            settled(F.size(F.array_intersect("a_s", "b_s"))).alias("common"),
            (F.size("a_s") + F.size("b_s")).alias("total"),
        )
        union = F.col("total") - F.col("common")
        similar = measured.where(F.col("common") * 100 >= union * self.settings.percent)
        similar = similar.select("doc_id", "duplicate_of", F.round(F.col("common") / union, 6).alias("jaccard"))
        best = Window.partitionBy("doc_id").orderBy(F.desc("jaccard"), "duplicate_of")
        return similar.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")

    def _fits(self) -> Column:
        """Sizes are like enough, and enough shingles are left after the places that meet."""
        percent = self.settings.percent
        rest = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
        sizes = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
        return sizes & (rest * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent)

    def rebuild(self) -> int:
        """Merge all runs into a new generation, ordered by today's rarity; its number.

        Needed when shingles that the first run did not have became frequent; it also makes
        one sorted table of many small runs. Rows keep their run, so a run can be done
        again afterwards. The old generation stays until its owner clears it.
        """
        current = self._generation()
        if current is None:
            raise FileNotFoundError(f"no index below {self.path}")
        number, sets = current + 1, self._runs("sets", _SETS, None)
        self._freeze(sets, number)
        prefixes = self._prefixes(sets, self._order(number)).join(sets.select("doc_id", "run"), "doc_id")
        sets.write.mode("overwrite").parquet(f"{self._folder(number)}/merged_sets")
        prefixes.repartitionByRange("h").sortWithinPartitions("h").write.mode("overwrite").parquet(
            f"{self._folder(number)}/merged_prefixes"
        )
        self._finish(number)
        return number
