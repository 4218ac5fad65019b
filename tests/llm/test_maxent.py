"""Maximum-entropy scores: exact base figures, learning, and odd rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlake.llm import maxent as m
from feedlake.llm.textrules import fold, space_words


def plain_base(rows, held):
    """rows: (id, text). {id: (n_tokens, n_known, N, base)} by direct counting."""
    counts = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in [*space_words(t), b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = [*space_words(t), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((i, len(words), sum(counts[w] > 0 for w in words), n, base))
    return out


def same(got, want):
    got = sorted((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    return got == sorted((*w[:4], round(w[4], 6)) for w in want)


@pytest.mark.parametrize("block", [16 << 20, 50])
def test_base_figures_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK_BYTES", block)
    texts = [None, "", "One one TWO", "Été \x1f x", "a b\tc\x0bd", "unseen words only here", "z " * 20_000, "a b c d"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "One one TWO")]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, token string, n int, block string")
    held = [i == 5 for i, _ in rows]
    got = m.scores(docs, F.col("doc_id") == 5).collect()
    assert same(got, plain_base(rows, held))
    assert all(r.score <= 0 and r.held_out == (r.id == 5) for r in got)
    assert m.scores(docs.where("false"), F.lit(True)).count() == 0
    nothing = m.scores(docs, F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known) for r in nothing} == {(0, 0)}


def test_null_id_row(spark):
    docs = spark.createDataFrame([(None, "some words"), (4, "some words")], "doc_id long, text string")
    got = m.scores(docs, F.col("doc_id") == 9).collect()
    assert {r.id for r in got} == {None, 4}
    assert len({(r.n_tokens, r.n_known, r.base_score, r.score) for r in got}) == 1


def random_weights(rng):
    both = rng.normal(size=(m.BUCKETS, m.GROUPS + m.CLASSES)).astype(np.float32)
    return m.Weights(rng.integers(1, 99, m.CLASSES), both)


def test_class_probabilities_sum_to_one():
    weights = random_weights(np.random.default_rng(1))
    hashes, at = np.full(m.CLASSES, 77, np.uint32), np.zeros(m.CLASSES, int)
    logs = m.class_log10(weights, hashes, at, np.arange(m.CLASSES))
    assert (10**logs).sum() == pytest.approx(1, abs=1e-4)
    assert np.array_equal(m.Weights(np.ones(m.CLASSES), weights.both()).both(), weights.both())


def tiny_words(rng, words=40):
    """Kinds, counts, cells and times of random words in a random order of histories."""
    kinds = np.sort(rng.integers(0, 3, words))
    last, skip = rng.integers(0, m.HISTORIES, 400), rng.integers(0, m.HISTORIES, 400)
    which = rng.integers(0, words, 400)
    which[last < 4] //= 4
    c = np.bincount(which, minlength=words)
    cells, times = np.unique(np.concatenate([which * m.SIDES + last, which * m.SIDES + m.HISTORIES + skip]), return_counts=True)
    seen = np.zeros((m.CLASSES, m.HISTORIES, m.HISTORIES))
    np.add.at(seen, (kinds[which], last, skip), 1)
    return kinds, c, cells, times, seen, (which, last, skip)


def test_words_of_a_class_sum_to_one_and_fit_better_by_round():
    kinds, c, cells, times, seen, (which, last, skip) = tiny_words(np.random.default_rng(5))
    tables, fits = [], []
    for _ in range(m.WORD_ROUNDS + 1):
        weights = m.word_weights(kinds, c, cells, times, tables)
        total = m.word_sums(kinds, c, weights) + 1
        for k, g, h in ((0, 3, 5), (2, 0, 15)):
            mine = kinds == k
            each = (c[mine] + 1) * np.exp(weights[mine, 0, g] + weights[mine, 1, h])
            assert each.sum() + 1 == pytest.approx(total[k, g, h], rel=1e-5)
        own = np.log(c + 1)[which] + weights[which, 0, last] + weights[which, 1, skip]
        fits.append((own - np.log(total[kinds[which], last, skip])).sum())
        tables = [*tables, seen / total]
    assert fits == sorted(fits) and fits[-1] > fits[0] + 5


def test_slope_of_words_matches_difference():
    kinds, c, cells, times, seen, (which, last, skip) = tiny_words(np.random.default_rng(6))
    start = np.zeros((len(c), 2, m.HISTORIES), np.float32)
    table = seen / (m.word_sums(kinds, c, start) + 1)

    def fit(weights):
        total = m.word_sums(kinds, c, weights) + 1
        own = weights[which, 0, last] + weights[which, 1, skip]
        return (own - np.log(total[kinds[which], last, skip])).sum()

    moved = m.word_weights(kinds, c, cells, times, [table])
    cell, n = cells[0], times[0]
    w, g = cell // m.SIDES, cell % m.HISTORIES
    nudged = start.copy()
    nudged[w, 0, g] = 1e-2
    slope = (fit(nudged) - fit(start)) / 1e-2
    expected = n - slope
    assert moved[w, 0, g] == pytest.approx(slope / (max(n, expected) + m.WORD_PRIOR), rel=0.05, abs=1e-3)


def plain_scores(rows, held, weights, classes):
    """Scores word by word from the model's own tables of groups and classes, and weights
    of words worked out over the whole corpus at once."""
    texts = [[*space_words(t), b""] for _, t in rows]
    learned = [t for t, h in zip(texts, held, strict=True) if not h]
    counts = Counter(w for t in learned for w in t)
    kind = lambda w: int(classes.of(np.array([m.word_hash(w)], np.uint32), np.array([m.ending(w)]))[0])
    words = sorted(counts, key=kind)
    bucket = lambda t, k, s: (m.word_hash(t[k - s]) if k >= s else int(m.BEFORE)) >> 28
    cells = Counter()
    seen = np.zeros((m.CLASSES, m.HISTORIES, m.HISTORIES))
    for t in learned:
        for k, w in enumerate(t):
            g, h = bucket(t, k, 1), bucket(t, k, 2)
            seen[kind(w), g, h] += 1
            cells[words.index(w) * m.SIDES + g] += 1
            cells[words.index(w) * m.SIDES + m.HISTORIES + h] += 1
    kinds, c = np.array([kind(w) for w in words]), np.array([counts[w] for w in words])
    at, times = np.array(sorted(cells)), np.array([cells[x] for x in sorted(cells)])
    tables = []
    for _ in range(m.WORD_ROUNDS):
        tables.append(seen / (m.word_sums(kinds, c, m.word_weights(kinds, c, at, times, tables)) + 1))
    own = m.word_weights(kinds, c, at, times, tables)
    total = m.word_sums(kinds, c, own) + 1
    out = []
    for t in texts:
        hashes, kk = np.array([m.word_hash(w) for w in t], np.uint32), np.array([kind(w) for w in t])
        score = m.class_log10(weights, hashes, np.arange(len(t)), kk).sum()
        for k, w in enumerate(t):
            g, h = bucket(t, k, 1), bucket(t, k, 2)
            up = math.log(counts[w] + 1)
            up += own[words.index(w), 0, g] + own[words.index(w), 1, h] if w in counts else 0
            score += (up - math.log(total[kk[k], g, h])) / math.log(10)
        out.append(score)
    return out


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_scores_against_plain_model(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK_BYTES", block)
    monkeypatch.setattr(m, "SHARD_BYTES", 100)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 300)) for i in range(30)]
    held = [i % 4 == 0 for i, _ in rows]
    kept = {}
    real = m.train

    def train(staged, classes):
        kept["classes"], kept["weights"] = classes, real(staged, classes)
        return kept["weights"]

    monkeypatch.setattr(m, "train", train)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.score for r in m.scores(docs, F.col("doc_id") % 4 == 0).collect()}
    want = plain_scores(rows, held, kept["weights"], kept["classes"])
    assert [got[i] for i, _ in rows] == pytest.approx(want, rel=2e-3)


def test_gradient_matches_difference():
    rng = np.random.default_rng(2)
    hashes, at = rng.integers(0, 99, 40).astype(np.uint32), np.arange(40)
    kinds = rng.integers(0, m.CLASSES, 40)
    weights, squares = m.Weights(np.ones(m.CLASSES)), m.Weights(np.ones(m.CLASSES))
    loss = lambda: -m.class_log10(weights, hashes, at, kinds).sum() * math.log(10)
    before = loss()
    row, k = m.features(hashes, at)[0, 20], kinds[20]
    slopes = []
    for table, r, c in ((weights.group, row, k // m.GROUP), (weights.classes, row * m.GROUPS + k // m.GROUP, k % m.GROUP)):
        table[r, c] = 1e-2
        slopes.append((loss() - before) / 1e-2)
        table[r, c] = 0
    uses = m.learn(weights, squares, hashes, at, kinds)
    assert squares.group[row, k // m.GROUP] == pytest.approx(slopes[0] ** 2, rel=0.05)
    assert squares.classes[row * m.GROUPS + k // m.GROUP, k % m.GROUP] == pytest.approx(slopes[1] ** 2, rel=0.05)
    assert loss() < before and uses.sum() == 40 * m.FEATURES


def test_features_stay_inside_a_text():
    words = np.array([1, 2, 3, 4, 5, 6], np.uint32)
    alone = m.features(words[3:], np.arange(3))
    after = m.features(words, np.array([0, 1, 2, 0, 1, 2]))[:, 3:]
    assert np.array_equal(alone, after)


def test_query_on_supplied_table(spark):
    from feedlake.llm.queries import op3_maxent

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    got = op3_maxent(spark, sf).withColumnRenamed("doc_id", "id").collect()
    assert same(got, plain_base(rows, held))
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    kept = spark.createDataFrame([(i,) for i, _ in rows], "i long").select("i", (fold(F.col("i"), 7) == 2).alias("h"))
    assert [r.h for r in kept.orderBy("i").collect()] == [h for _, h in sorted(zip([i for i, _ in rows], held, strict=True))]


def test_classes_of_words():
    heads = [m.word_hash(w) for w in (b"the", b"", b"zz")]
    classes = m.Classes(heads, np.zeros(m.CLASSES), np.zeros(m.CLASSES))
    words = [b"zz", b"a", b"the", "été".encode(), b""]
    got = classes.of(np.array([m.word_hash(w) for w in words], np.uint32), np.array([m.ending(w) for w in words]))
    assert got.tolist() == [2, m.HEADS + m.ending(b"a"), 0, m.HEADS + m.ending("été".encode()), 1]
