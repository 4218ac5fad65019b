"""Repeated byte strings against looking at every window."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from feedlake.llm import repeats as r


def plain(rows, length):
    datas = [(t or "").encode() for _, t in rows]
    seen = Counter(d[p : p + length] for d in datas for p in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, datas, strict=True):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def some(rng, n, letters="abcdefgh é"):
    return "".join(rng.choice(letters) for _ in range(n))


def tables(seed, letters="abcdefgh é"):
    rng = random.Random(seed)
    passages = [some(rng, n, letters) for n in (190, 199, 200, 201, 260, 700)]
    texts = []
    for _ in range(60):
        parts = [some(rng, rng.randrange(0, 400), letters)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 60)
            parts += [p[cut:] if rng.random() < 0.5 else p, some(rng, rng.randrange(0, 200), letters)]
        texts.append("".join(parts))
    base = some(rng, 1500, letters)
    for _ in range(8):
        k = rng.randrange(1500)
        texts.append(base[:k] + "Z" + base[k + 1 :])
    texts += [base, base, "ab" * 400, "x" * 199, "y" * 200, "z" * 201, "", None]
    return list(enumerate(texts))


@pytest.mark.parametrize(("length", "gram", "block"), [(200, 32, 1 << 20), (200, 32, 97), (40, 8, 1 << 20), (40, 40, 50)])
def test_against_every_window(spark, monkeypatch, length, gram, block):
    monkeypatch.setattr(r, "BLOCK", block)
    rows = tables(length + gram + block % 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = r.repeated_spans(docs, length=length, gram=gram)
    text = spans.select("doc_id", r.kept(r.F.coalesce("text", r.F.lit("")), spans.spans).alias("k"), "spans", "text").collect()
    got = []
    for x in text:
        data = (x.text or "").encode()
        whole = hashlib.sha256(data).hexdigest()
        got.append((x.doc_id, len(data), x.k.n_removed, x.k.n_spans, x.k.sha256 if x.spans is not None else whole))
    assert sorted(map(repr, got)) == plain(rows, length)


def test_few_letters(spark):
    rows = tables(9, "ab")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(x)) for x in r.report(docs).collect()) == plain(rows, 200)


def test_odd_rows(spark):
    rng = random.Random(4)
    text = some(rng, 450)
    rows = [(1, text), (1, text), (2, some(rng, 450)), (2, some(rng, 100) + text[100:350]), (None, None), (None, text[:230]), (3, "a" * 300_000)]
    docs = spark.createDataFrame([(*x, "k", 1, "s") for x in rows], "doc_id long, text string, key string, first int, spans string")
    assert sorted(repr(tuple(x)) for x in r.report(docs).collect()) == plain(rows[:-1], 200)[:0] + sorted(
        [*plain(rows[:-1], 200), repr((3, 300_000, 300_000, 1, hashlib.sha256(b"").hexdigest()))]
    )
    assert r.report(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="gram"):
        r.repeated_spans(docs, gram=4)


def test_query_on_supplied_table(spark):
    from feedlake.llm.queries import op10_repeats

    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(repr(tuple(x)) for x in op10_repeats(spark, sf).collect()) == plain(rows, 200)


def test_windows_are_shuffled_once(spark):
    """What counts the windows and what keeps the repeated ones read the same shuffle."""
    docs = spark.createDataFrame(tables(7), "doc_id long, text string").repartition(4)
    found = r.repeated_stretches(r._keyed(docs, "doc_id", "text"), "text", 40, 8)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.search(r"ReusedExchange \[window", plan)
