"""Wu-Manber search against scanning every position."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from feedlake.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, passage in items:
        other = plain_words(passage)
        size = min(10, len(other))
        wins = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def random_tables(seed, letters="ab", lengths=(0, 1, 2, 3, 9, 10, 11, 25)):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, some(rng.choice(lengths))) for i in range(12)]
    docs = [some(rng.randrange(60)) + ". " + rng.choice(items)[1] + "! " + some(5) for _ in range(60)]
    return items, docs


@pytest.mark.parametrize("slice_bytes", [32 << 20, 200])
@pytest.mark.parametrize("letters", [["a", "b"], [f"w{i}" for i in range(40)]])
def test_random_against_scan(spark, monkeypatch, slice_bytes, letters):
    monkeypatch.setattr(d, "SLICE_BYTES", slice_bytes)
    items, docs = random_tables(len(letters), letters)
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.id: r for r in d.contamination(table, bench).collect()}
    for i, text in enumerate(docs):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == plain(text, items)
        assert sum(s.stop - s.start for s in got[i].spans) == got[i].n_hit


def test_odd_rows(spark):
    passage = "One two, three four five SIX seven eight nine ten Éleven"
    items = [(1, passage), (2, passage), (10, "Solo!"), (3, None), (4, "..."), (None, "lost words"), (1, passage)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    texts = [None, "", "solo", "Sol o", "say " + passage.upper().replace("É", "é") + " eleven", passage[4:], passage]
    rows = [(i, t, "en", 7, "x") for i, t in enumerate(texts)] + [(6, passage, "en", 7, "x"), (None, "solo", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, n_hit int, items string")
    got = d.contamination(docs, bench).collect()
    assert len(got) == len(rows)
    named = [(i, t) for i, t in items if i is not None]
    for (i, text, *_), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0])), sorted(got, key=lambda r: (r.id is not None, r.id)), strict=True):
        assert (r.id, r.n_words, r.n_hit, r["items"]) == (i, *plain(text, named))
    clean = d.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [0, 1, 3]
    assert d.contamination(docs.where("false"), bench).count() == 0
    assert d.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_long_text(spark):
    text = "word " * 300_000 + "one two three four five six seven eight nine ten"
    searcher = d.Searcher({tuple(w): ["1"] for w in d.windows("one two three four five six seven eight nine ten")})
    spans, items = d.search(d.alnum_words(text), searcher)
    assert (spans, items) == ([(300_000, 300_010)], {"1"})


def test_digest(spark):
    row = spark.sql("select array('1', '10', '2') as a, cast(array() as array<string>) as b")
    got = row.select(d.items_digest(row.a), d.items_digest(row.b)).first()
    assert list(got) == [hashlib.sha256(b"1,10,2").hexdigest(), hashlib.sha256(b"").hexdigest()]
