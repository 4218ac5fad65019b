"""Order MinHash against a plain reading of its definition."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash

from feedlake.llm import ordermin as o


def chain(*values):
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q" if v[1] == 8 else "<i", v[0])
        h = xxhash.xxh64_intdigest(data, h)
    return h


def plain_fingerprint(text):
    units = re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")
    if not units:
        kmers = []
    elif len(units) < o.KMER:
        kmers = [chain(" ".join(units)) >> 30]
    else:
        kmers = [chain(*units[i : i + o.KMER]) >> 30 for i in range(len(units) - o.KMER + 1)]
    seen, numbered = Counter(), []
    for at, k in enumerate(kmers):
        numbered.append((chain((k, 8), (seen[k], 4)), at))
        seen[k] += 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    digits = []
    for j in range(o.SKETCHES):
        halves = [[], []]
        for h, at in numbered:
            mixed = chain((signed(h), 8), (j, 4))
            halves[mixed & 1].append((signed(mixed >> 30 << 30 | at), mixed >> 30, at))
        picked = sorted((min(x)[2], min(x)[1]) for x in halves if x)
        h = 42
        for _, part in picked:
            h = xxhash.xxh64_intdigest(struct.pack("<q", part), h)
        digits.append(f"{h & 0xFFFFFFFF:08x}")
    return "".join(digits)


TEXTS = ["", None, "one", "one two", "one  two\tthree", "a b c a b c a b c a b c", "x " * 500, "naïve日本語の長い文章です and more words here", "The quick brown fox jumps over the lazy dog again"]


def test_fingerprints(spark):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, row string, p int")
    got = {r.id: r.fingerprint for r in o.fingerprints(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}
    assert o.fingerprints(docs.where("false")).count() == 0


def plain_report(rows):
    """rows: (id, text). Expected rows of the report, in any order."""
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True)
    least = {i: min(t or "" for j, t in rows if j == i) for i in ids}
    out = []
    for i, text in rows:
        text = text or ""
        nxt = ids[(ids.index(i) + 1) % len(ids)] if i is not None else None
        cut = len(text) // 3
        edited = text[: len(text) - cut] + (least[nxt][:cut] if i is not None else "")
        a, b = plain_fingerprint(text), plain_fingerprint(edited)
        like = lambda x, y: sum(x[8 * j : 8 * j + 8] == y[8 * j : 8 * j + 8] for j in range(o.SKETCHES)) / o.SKETCHES
        near = like(a, min(plain_fingerprint(t) for j, t in rows if j == nxt)) if i is not None else 0.0
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), near))
    return out


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("shift", [0, 3])
def test_report_with_odd_rows(spark, shift):
    rows = [((i * 37 + shift) % 101 - 20, t) for i, t in enumerate(TEXTS * 3)]
    rows += [rows[4], (rows[5][0], "another text under this id"), (None, "no id at all here"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", "y", 2) for r in rows], "doc_id long, text string, head string, sha string, n int")
    got = o.edit_report(docs).collect()
    assert sorted(map(key, got)) == sorted(map(key, plain_report(rows)))


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(5, "alone in the table with a few words")], "doc_id long, text string")
    assert [key(r) for r in o.edit_report(docs).collect()] == [key(r) for r in plain_report([(5, docs.first().text)])]
    assert o.edit_report(docs.where("false")).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(120_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert {r.fingerprint for r in o.fingerprints(docs).collect()} == {plain_fingerprint(text)}


def test_query_on_supplied_table(spark):
    from feedlake.llm.queries import op9_fingerprints

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op9_fingerprints(spark, sf)
    assert got.columns[0] == "doc_id"
    got = got.collect()
    assert sorted(map(key, got)) == sorted(map(key, plain_report(rows)))
    assert sum(r.near_edited for r in got) / len(got) > 0.15
