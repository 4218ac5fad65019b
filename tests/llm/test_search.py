"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from feedlake.llm import search as m
from feedlake.llm.textrules import alnum_words


def plain(docs, items, top=10):
    """docs: (id, text), items: (item, text) -> sorted (item, rank, score, id)."""
    counts = [(i, Counter(alnum_words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            norm = 10 + (90 * c.total() * n_docs) // n_terms
            score = 0
            for t in set(alnum_words(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * norm))
            if score > 0:
                found.append((-score, i is None, 0 if i is None else i, i))
        out += [(item, k, -x[0], x[3]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.item, r["rank"], r.score, r.id) for r in found.collect()), key=str)


def corpus(seed, count):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    return [" ".join(rng.choices(vocabulary, k=int(rng.paretovariate(0.5)) % 900)) for _ in range(count)]


@pytest.mark.parametrize("bits", [1, 16])
def test_against_plain(spark, monkeypatch, bits):
    """With one bit a term the bounds are loose, and the results the same."""
    monkeypatch.setattr(m, "BITS_PER_TERM", bits)
    docs = list(enumerate(corpus(1, 700))) + [(5000, None), (5001, ""), (5002, "... !"), (5003, "W1 w2 " * 30_000), (None, "w7 w8 w9")]
    docs += [(k, "w3 copies of one text w5") for k in range(6000, 6040)] + [(7, "w3 again")]
    items = [(k, t) for k, t in enumerate(corpus(2, 40))] + [(100, None), (101, ""), (102, "unknown"), (103, "w3 copies"), (103, "W9 w9"), (None, "w5")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(m.ranked_search(frame, asked)) == plain(docs, items)


def test_groups_floors_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "GROUP_PAIRS", 200)
    monkeypatch.setattr(m, "BLOCK_DOCS", 16)
    monkeypatch.setattr(m, "FLOOR_BLOCKS", 2)
    monkeypatch.setattr(m, "HELD_TERMS", 10)
    monkeypatch.setattr(m, "CELLS", 64)
    docs, items = list(enumerate(corpus(3, 300))), list(enumerate(corpus(4, 15)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(m.ranked_search(frame, asked, top=3)) == plain(docs, items, 3)


def test_bounds_are_no_lower_than_scores():
    texts = corpus(5, 60)
    counts = [Counter(alnum_words(t)) for t in texts]
    block = m._Block(1024)
    for k, (t, c) in enumerate(zip(texts, counts, strict=True)):
        if c:
            block.add(k, t, c)
    row = block.row()
    n_docs, n_terms = len(row["ids"]), sum(row["lengths"])
    df = Counter(t for c in counts for t in c)
    terms = {t: k for k, t in enumerate(sorted(df))}
    weights = np.array([m.term_weight(n_docs, df[t]) for t in terms])
    group = m.Group([0], terms, weights, np.arange(len(terms)), np.array([0]), n_docs, n_terms, np.zeros(1))
    hashes = m.term_hashes(terms, len(terms))
    lengths = np.array(row["lengths"])
    slices = np.frombuffer(row["slices"], np.uint8).reshape(1024, -1)
    found = m.bounds(group, [m.entries(hashes, k) for k in range(len(m.LEVELS))], lengths, 1024, slices)
    norm = group.length_norm(lengths)
    for d, k in enumerate(row["ids"]):
        score = sum(weights[terms[t]] * group.part(np.array([n]), norm[d])[0] for t, n in counts[k].items())
        assert score <= found[0, d]


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2, 3)], "doc_id long, text string, term string, df int, key int")
    items = spark.createDataFrame([(1, "a", 5, "y")], "item_id int, text string, rank int, item string")
    names = ["item", "rank", "id", "score"]
    for one, other in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("false"), items.where("false"))):
        found = m.ranked_search(one, other)
        assert (found.columns, found.count()) == (names, 0)
    assert rows_of(m.ranked_search(docs, items)) == plain([(1, "a b")], [(1, "a")])
