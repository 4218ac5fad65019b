"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from feedlake.llm import resample as m

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, ngram):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda x: x[0].lower(), (text or "").encode()))
    runs = [b" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]
    return len(words), runs


def plain(docs, target, ngram, buckets, min_words, percent):
    """docs: (id, text) -> {id: (n_features, weight, score, rank)}; ids are distinct."""
    counts = []
    for texts in ([t for _, t in docs], target):
        total = [0] * buckets
        for text in texts:
            for run in grams(text, ngram)[1]:
                total[zlib.crc32(run) % buckets] += 1
        counts.append(total)
    s, t = map(sum, counts)
    gain = [
        math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(*counts, strict=True)
    ]
    out = {}
    for i, text in docs:
        words, runs = grams(text, ngram)
        weight = sum(gain[zlib.crc32(r) % buckets] for r in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(runs), weight, weight + noise, None, words]
    eligible = sorted((i for i in out if out[i][4] >= min_words), key=lambda i: (-out[i][2], i is None, i))
    for place, i in enumerate(eligible[: percent * len(eligible) // 100], 1):
        out[i][3] = place
    return {i: tuple(x[:4]) for i, x in out.items()}


def texts(seed, count):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "naïve", "x’y", "日本", "UP", "a-b", "12", "\n", "\x00"]
    return [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))) for _ in range(count)]


@pytest.mark.parametrize("ngram", [1, 3])
def test_against_plain(spark, ngram):
    docs = list(enumerate(texts(1, 200))) + [(900, None), (901, ""), (902, "--- !"), (903, "long " * 50_000), (None, "one two three four five")]
    target = [*texts(2, 20), None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = m.resample(frame, items, ngram=ngram, buckets=97, min_words=5, percent=40).collect()
    assert {r.id: (r.n_features, r.weight, r.score, r["rank"]) for r in got} == plain(docs, target, ngram, 97, 5, 40)
    assert len(got) == len(docs)


def test_batches_are_cut_between_documents():
    held = [t.encode() for t in texts(3, 50)]
    words, owner, bucket = m.ngram_buckets(held, 2, 1000)
    for k, text in enumerate(held):
        n, runs = grams(text.decode(), 2)
        assert words[k] == n
        assert sorted(bucket[owner == k]) == sorted(zlib.crc32(r) % 1000 for r in runs)
    assert m.ngram_buckets([b"", b"..."], 3, 10)[2].size == 0
    assert np.array_equal(m.ngram_buckets([b"", b"..."], 3, 10)[0], [0, 0])


def test_ties_repeats_clashing_names_and_empty_tables(spark):
    text = " ".join(f"t{k}" for k in range(25))
    rows = [(1, text), (1, text), (2, text), (3, "short")] * 5
    docs = spark.createDataFrame([(*r, 0, "x", 7, 8) for r in rows], "doc_id long, text string, rank int, score string, weight int, id int")
    items = spark.createDataFrame([("t1 t2", 1)], "text string, bucket int")
    got = m.resample(docs, items, percent=60).collect()
    assert len(got) == 20
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, 10))
    ordered = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r.score for r in ordered] == sorted((r.score for r in ordered), reverse=True)
    assert m.drawn(docs, items, percent=60).columns == docs.columns
    assert m.resample(docs.where("false"), items).count() == 0
    assert m.resample(docs, items.where("false")).count() == 20
    assert m.resample(docs.where("id is null"), items.where("false")).count() == 0


def test_likely_documents_are_drawn(spark):
    rng = random.Random(5)
    vocab = {k: [f"{k}{i}" for i in range(40)] for k in "ab"}
    docs = [(i, " ".join(rng.choices(vocab["a" if i % 10 == 0 else "b"], k=60))) for i in range(1000)]
    items = spark.createDataFrame([(" ".join(vocab["a"]),)] * 5, "text string")
    got = m.resample(spark.createDataFrame(docs, "doc_id long, text string"), items, percent=5)
    drawn = [r.id for r in got.where("rank is not null").collect()]
    assert len(drawn) == 50
    assert sum(i % 10 == 0 for i in drawn) > 25
