"""SimHash and components against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
import xxhash

from feedlake.llm import simhash
from feedlake.llm.components import connected_components


def plain_simhash(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, linked):
    """items: list of (id, value). Least id reachable per id."""
    parent = {i: i for i, _ in items}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, x), (j, y) in itertools.combinations(items, 2):
        if linked(x, y):
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return {i: top(i) for i, _ in items}


TEXTS = ["", None, " \t\n", "One", "one", "a b", "A B c", "a b c d", "ä B c\x0bd\x1fe", "x y z", "q " * 70000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.simhash(text) == plain_simhash(text)


def test_masks_cover():
    masks = [m % (1 << 64) for m in simhash.covering_masks(2)]
    assert len(masks) == 7
    for i, j in itertools.product(range(64), repeat=2):
        assert any((1 << i | 1 << j) & m == 0 for m in masks)


def near_values(seed, families, members):
    rng = random.Random(seed)
    values = []
    for _ in range(families):
        x = rng.getrandbits(64)
        for _ in range(members):
            values.append(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.7:
                x ^= 1 << rng.randrange(64)
    return values


@pytest.mark.parametrize(("radius", "bucket"), [(0, 64), (1, 64), (2, 64), (1, 2), (2, 2)])
def test_links(spark, monkeypatch, radius, bucket):
    monkeypatch.setattr(simhash, "PAIRWISE_BUCKET", bucket)
    values = sorted(set(near_values(radius, 12, 9)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "simhash long")
    roots = {r.node: r.root for r in connected_components(simhash.links(prints, radius)).collect()}
    want = plain_components([(v, v) for v in signed], lambda x, y: ((x ^ y) % (1 << 64)).bit_count() <= radius)
    got = {v: roots.get(v, v) for v in signed}
    groups = lambda d: {frozenset(k for k in d if d[k] == r) for r in set(d.values())}
    assert groups(got) == groups(want)


def test_radius_is_checked(spark):
    with pytest.raises(ValueError, match="radius"):
        simhash.links(spark.createDataFrame([(1,)], "simhash long"), 3)


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 499)] * 2
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {499: 499, 500: 499}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


SCHEMA = "doc_id long, text string, id string, simhash int, component string, a string, n long, root string"


def test_near_duplicates_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "  ", base, base.upper(), base + " tail", "one two", "one two", "other words here now"]
    more = ("x", 1, "c", "a", 5, "r")
    rows = [(10 - i, t, *more) for i, t in enumerate(texts)]
    rows += [(None, base, *[None] * 6), (7, base, *more)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r.id, r.simhash, r.component) for r in simhash.near_duplicates(docs).collect()]
    items = [(r[0], plain_simhash(r[1])) for r in rows]
    want = plain_components([x for x in dict.fromkeys(items) if x[0] is not None], lambda x, y: (x ^ y).bit_count() <= 2)
    assert len(got) == len(rows)
    for i, value, component in got:
        assert component == (want[i] if i is not None else want[7])
        assert value % (1 << 64) == dict(items)[i]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1
    empty = docs.where("false")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_query_on_supplied_table(spark):
    from feedlake.llm.queries import op2_simhash

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, plain_simhash(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_components(docs, lambda x, y: (x ^ y).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, sf).collect()}
    assert got == {i: (f"{v:016x}", want[i]) for i, v in docs}
