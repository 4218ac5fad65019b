"""Pairs of like sets: what is moved and written, and that nothing is lost by it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from feedlake.operators import insights, likeness


def drifting(families=8, members=14, seed=3):
    """Families that drift word by word, each with an exact copy."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(families):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 100))]
        for _ in range(members):
            texts.append(" ".join(words))
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(texts[-3])
    rng.shuffle(texts)
    return texts


def brute_force(docs):
    def grams(text):
        w = text.split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {text}

    sets = {i: grams(t) for i, t in docs if i is not None}
    found = {}
    for doc in sets:
        scored = [(len(sets[doc] & sets[o]) / len(sets[doc] | sets[o]), o) for o in sets if o < doc]
        best = max((x[0] for x in scored), default=0)
        if best >= 0.8:
            found[doc] = (min(o for share, o in scored if share == best), round(best, 6))
    return found


def links(rows):
    return {r.doc_id: (r.duplicate_of, r.jaccard) for r in rows.collect()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_small_counters_blocks_and_groups(spark, monkeypatch, kind):
    """Counters that all share, families in many blocks, groups of few pairs; a row without
    an id and rows that come twice change nothing."""
    for name, value in (("COUNTERS", 64), ("_PART", 16), ("_SLICE", 50), ("BLOCK", 300), ("MEMBERS", 5), ("GROUP", 200)):
        monkeypatch.setattr(likeness, name, value)
    docs = [(i if kind == "long" else f"{i:04d}", t) for i, t in enumerate(drifting())]
    want = brute_force(docs)
    rows = [*docs, *docs[5:40], (None, docs[9][1])]
    got = links(insights.near_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string")))
    assert got == want and len(want) > 60


def sets_of(spark, lists):
    return spark.createDataFrame([(i, len(s), sorted(s)) for i, s in enumerate(lists)], "doc_id long, n int, s array<int>")


def test_a_pair_comes_once_for_each_run_of_shared_numbers(spark):
    """Sets with the same beginning meet at its first number only; none is missed."""
    rng = random.Random(1)
    common = rng.sample(range(10**6), 200)
    sets = sets_of(spark, [common[: 200 - i] for i in range(0, 30, 2)])
    prefixes = likeness.rarest(sets, likeness.counted(sets), 80)
    met = likeness.met(prefixes, 80)
    assert met.distinct().count() == 15 * 14 // 2
    assert met.count() < 4 * 15 * 14 // 2


def test_numbers_are_ordered_where_they_lie(spark):
    """Rarest first, ties by number, and only as many as a like set must share one of."""
    sets = sets_of(spark, [[1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [1, 2, 3, 20], [1, 30], [2**31 - 2]])
    prefixes = likeness.rarest(sets, likeness.counted(sets), 80)
    assert "Exchange" not in prefixes._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.p for r in prefixes.collect()} == {0: [4, 5, 6], 1: [20], 2: [30], 3: [2**31 - 2]}


def test_sketches_drop_unlike_pairs_and_no_like_one(spark):
    """Before whole sets are moved; sketches of 64 to 256 bits, of two lengths in one pair, and
    numbers that fall to the same bit."""
    rng = random.Random(4)
    lists = [rng.sample(range(2**31 - 1), n) for n in (40, 60, 120, 200, 240)]
    lists += [rng.sample(range(0, 2**20, 2**10), 90)]
    sets, like = [], set()
    for s in lists:
        more = rng.sample(range(2**31 - 1), len(s) // 8)
        sets += [s, s + more, s[len(s) // 10 :]]
        k = len(sets)
        like |= {(k - 2, k - 3), (k - 1, k - 3)}
    every = [(a, b) for a in range(len(sets)) for b in range(a)]
    found = spark.createDataFrame(every, "doc_id long, other long")
    left = {(r.doc_id, r.other) for r in likeness.sifted(sets_of(spark, sets), found, 80).collect()}
    assert like <= left and len(left) < len(every) // 4


def on_disk(spark):
    """Bytes of shuffles that this session keeps."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()))


def test_disk_is_bounded_by_the_texts(spark, tmp_path):
    """Unlike texts: their shingles are stored once, and only prefixes are shuffled."""
    rng = random.Random(2)
    docs = [(i, " ".join(f"{rng.randrange(10**6):06d}" for _ in range(2000))) for i in range(400)]
    text = sum(len(t) for _, t in docs)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    given, before = spark.read.parquet(str(tmp_path / "docs")), on_disk(spark)
    assert insights.near_duplicates(given).count() == 0
    assert on_disk(spark) - before < text
