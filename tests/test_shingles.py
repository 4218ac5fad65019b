"""Near duplicates of batches against stored history."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from feedlake.operators.insights import near_duplicates
from feedlake.sinks import shingles
from feedlake.sinks.shingles import ShingleIndex


def corpus():
    """Families that drift word by word, a hot family of copies, and odd texts."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    families = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))] for _ in range(12)]
    docs = []
    for i in range(180):
        words = families[0 if i % 3 == 0 else rng.randrange(12)]
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i, " ".join(words)))
    copied = docs[0][1]
    docs += [(i, copied) for i in range(180, 200)] + [(200, ""), (201, "tiny"), (202, "tiny"), (203, "")]
    return docs


def links(rows):
    return {r.doc_id: (r.duplicate_of, r.jaccard) for r in rows.collect()}


@pytest.mark.parametrize("cuts", [(204,), (1, 140, 204)])
def test_batches_and_history_equal_one_pass(spark, tmp_path, cuts):
    docs = corpus()
    whole = links(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert len(whole) > 100
    index = ShingleIndex(spark, str(tmp_path / "index"))
    got, start = {}, 0
    for number, end in enumerate(cuts):
        batch = spark.createDataFrame(docs[start:end], "doc_id long, text string")
        got |= links(index.add(batch, f"{number:04d}"))
        start = end
    assert got == whole


def test_rebuild_and_repeated_runs(spark, tmp_path):
    docs = corpus()
    frames = [spark.createDataFrame(docs[i : i + 68], "doc_id long, text string") for i in (0, 68, 136)]
    index = ShingleIndex(spark, str(tmp_path / "index"))
    first = links(index.add(frames[0], "0"))
    second = links(index.add(frames[1], "1"))
    assert links(index.add(frames[1], "1")) == second
    assert index.rebuild() == 1
    assert links(index.add(frames[1], "1")) == second
    third = links(index.add(frames[2], "2"))
    assert index.rebuild() == 2
    assert links(index.add(frames[2], "2")) == third
    whole = links(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert first | second | third == whole


def test_odd_rows(spark, tmp_path):
    index = ShingleIndex(spark, str(tmp_path / "index"))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert links(index.add(empty, "0")) == {}
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (4, "z " * 50_000)]
    batch = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit("x"))
    assert links(index.add(batch, "1")) == {2: (1, 1.0)}
    assert links(index.add(empty, "2")) == {}
    more = spark.createDataFrame([(5, "A, b; c d e f"), (6, "z " * 70_000)], "doc_id long, text string")
    assert links(index.add(more, "3")) == {5: (3, 1.0), 6: (4, 1.0)}


def test_texts_of_history_are_not_read(spark, tmp_path):
    """A batch meets stored hashes only, and stores its own new sets only."""
    docs = corpus()
    index = ShingleIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(docs, "doc_id long, text string"), "0")
    index.add(spark.createDataFrame([(900, docs[7][1])], "doc_id long, text string"), "1")
    sets = spark.read.parquet(f"{index.path}/generation=0/sets")
    assert "text" not in sets.columns
    assert sets.where("doc_id = 900").isEmpty()


def test_sets_are_ordered_where_they_lie(spark, tmp_path, monkeypatch):
    """Prefixes need no shuffle; few counters that all shingles share change no link."""
    docs = corpus()
    whole = links(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    monkeypatch.setattr(shingles, "COUNTERS", 64)
    monkeypatch.setattr(shingles, "_PART", 16)
    monkeypatch.setattr(shingles, "_SLICE", 50)
    index = ShingleIndex(spark, str(tmp_path / "index"))
    got = links(index.add(spark.createDataFrame(docs[:140], "doc_id long, text string"), "0"))
    sets = spark.read.parquet(f"{index.path}/generation=0/sets")
    prefixes = index._prefixes(sets, index._order(0))
    assert "Exchange" not in prefixes._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(shingles, "COUNTERS", 128)
    assert got | links(index.add(spark.createDataFrame(docs[140:], "doc_id long, text string"), "1")) == whole


def test_an_index_without_counters_is_rebuilt(spark, tmp_path):
    docs = corpus()
    index = ShingleIndex(spark, str(tmp_path / "index"))
    got = links(index.add(spark.createDataFrame(docs[:140], "doc_id long, text string"), "0"))
    spark.createDataFrame([], "h long, f long").write.mode("overwrite").parquet(f"{index.path}/generation=0/order")
    got |= links(index.add(spark.createDataFrame(docs[140:], "doc_id long, text string"), "1"))
    assert index._generation() == 1
    assert got == links(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
