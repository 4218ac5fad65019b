"""The line join against comparing every two lines."""

from __future__ import annotations

import itertools
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from feedlake.llm import keyfilter
from feedlake.llm import lines as m
from feedlake.llm.textrules import space_words


def plain(rows, similarity=Fraction(4, 5)):
    """rows: (id, text) -> set of result rows without hashes, by brute force."""
    order = lambda loc: (loc[0] is not None, loc[0] or 0, loc[1])
    placed = {}
    for i, text in rows:
        for number, line in enumerate((text or "").split("\n"), 1):
            words = frozenset(space_words(line))
            if words:
                placed.setdefault((i, number, words), None)
    first = {}
    for i, number, words in placed:
        first[words] = min(first.get(words, (i, number)), (i, number), key=order)
    links = {w: [] for w in first}
    for x, y in itertools.combinations(first, 2):
        if len(x & y) >= similarity * len(x | y):
            links[x].append(y)
            links[y].append(x)
    out = set()
    for i, number, words in placed:
        match = min([first[words], *(first[o] for o in links[words])], key=order)
        out.add((i, number, *first[words], len(links[words]), *match, match != (i, number)))
    return out


def rows_of(frame):
    names = ["id", "line", "first_id", "first_line", "n_links", "match_id", "match_line", "removed"]
    return {tuple(r) for r in frame.select(*names).collect()}


def varied(seed, lines, vocabulary):
    rng = random.Random(seed)
    made = []
    for _ in range(lines):
        if made and rng.random() < 0.6:
            words = rng.choice(made).split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))]
        made.append(" ".join(words))
    rng.shuffle(made)
    return [(i, "\n".join(made[k : k + 5])) for i, k in enumerate(range(0, lines, 5))]


@pytest.mark.parametrize("similarity", [Fraction(4, 5), Fraction(1, 2), Fraction(9, 10)])
@pytest.mark.parametrize("vocabulary", [12, 400])
def test_against_brute_force(spark, similarity, vocabulary):
    rows = varied(vocabulary, 300, [f"w{i}" for i in range(vocabulary)])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(m.similar_lines(docs, similarity=similarity)) == plain(rows, similarity)


def test_small_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(keyfilter, "MOST_BITS", 3)
    monkeypatch.setattr(m, "VERIFY_PAIRS", 3)
    monkeypatch.setattr(m, "_CHUNK", 7)
    monkeypatch.setattr(m, "_SLICE", 100)
    rows = varied(5, 150, [f"w{i}" for i in range(30)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(m.similar_lines(docs)) == plain(rows)


def test_odd_rows_and_removal(spark):
    long = " ".join(f"x{i}" for i in range(3000))
    rows = [
        (3, "a b c d e\nf g h\n\n  \nA B C D E"), (1, "a b c d e f\nsolo"), (2, None), (4, ""), (None, "f g h\nown"),
        (None, "late words"), (3, "a b c d e\nf g h\n\n  \nA B C D E"), (5, long), (6, long + " more"), (5, "other text\nsolo"), (7, "solo"),
    ]
    docs = spark.createDataFrame(
        [(i, t, len(t or ""), "x", "y") for i, t in rows], "doc_id long, text string, n_chars long, line string, id string"
    )
    assert rows_of(m.similar_lines(docs)) == plain(rows)
    kept = m.drop_later_lines(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in kept.collect())
    want = {
        "3": "\n  ", "1": "a b c d e f\nsolo", "2": None, "4": "", "7": "",
    }
    for i, text, n in got:
        assert n == len(text or "")
        if i in want:
            assert text == want[i]
    assert ("None", "f g h\nown", 9) in got and ("5", long, len(long)) in got and ("6", "", 0) in got
    assert ("5", "other text", 10) in got
    assert len(got) == len(rows)
    empty = docs.where("false")
    assert m.similar_lines(empty).count() == 0
    assert m.drop_later_lines(empty).count() == 0


def test_pairs_of_one_word_are_split(spark):
    rows = [(a, b, 7) for a, b in itertools.combinations(range(200), 2)] + [(a, a + 1, a) for a in range(1000, 1300)]
    pairs = spark.createDataFrame(rows, "a long, b long, word int")
    dealt, needed = m.verify_parts(pairs, 500)
    got = [tuple(r) for r in dealt.collect()]
    assert sorted(r[1:] for r in got) == sorted(r[:2] for r in rows)
    largest = max(Counter(r[0] for r in got).values())
    assert largest < 3 * 500
    assert {tuple(r) for r in needed.collect()} >= {(p, x) for p, *ends in got for x in ends}
    assert needed.count() < 200 * 2 * 8 + 2 * 300


def test_rows_without_an_id_get_their_own_lines(spark):
    texts = [f"only here number {k} word{k} again{k}\nshared line of some words\nclose to w{k} x{k} y{k} z{k}" for k in range(60)]
    rows = [(None, t) for t in texts] + [(None, "shared line of some words\nshared line of some words"), (1, "shared line of some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = {(r[0], r[1]) for r in plain(rows) if r[-1] and r[0] is None}
    assert gone == {(None, 2)}
    want = ["\n".join(x for k, x in enumerate(t.split("\n"), 1) if k != 2) for t in texts]
    want += ["shared line of some words", ""]
    assert sorted(r.text for r in m.drop_later_lines(docs).collect()) == sorted(want)
    keyed = docs.where("doc_id is null").withColumn("__row", F.monotonically_increasing_id()).localCheckpoint()
    marks = m.nameless_marks(keyed, m.similar_lines(docs).where("removed and id is null"), "text")
    assert {len(r["marks"]) for r in marks.collect()} == {1}


def test_words_and_sets_of_a_text():
    rng = random.Random(3)
    texts = ["", "\n\n", "a", " a\tb\x0bc\x0cd\r\n\x1c e", "x" * 700_000 + " y", "é日 \x00\x01 a"]
    texts += ["".join(rng.choices("ab \n\t", k=k)) for k in range(40)] + [" ".join(str(rng.random()) for _ in range(60_000))]
    known = {}
    for text in texts:
        hashes, line = m.words_of(text.encode())
        want = [(w, k) for k, x in enumerate(text.split("\n")) for w in space_words(x)]
        assert line.tolist() == [k for _, k in want]
        for (word, _), h in zip(want, hashes.tolist(), strict=True):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    one, two = m.sets_of(b"b a a c\n\nc b a"), m.sets_of(b"a b c d")
    assert one.line.tolist() == [0, 2] and one.sizes.tolist() == [3, 3]
    assert one.keys()[0][0] == one.keys()[0][1] != two.keys()[0][0]


def test_column_names_of_the_lines_own(spark):
    rows = [(1, "a b c d e\nx y z", 3), (2, "a b c d e", 4), (None, "x y z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int").selectExpr(
        "*", "gone_id as __gone", "gone_id as __gone_id", "gone_id as gone_lines", "gone_id as gone_row", "gone_id as part"
    )
    kept = m.drop_later_lines(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text, r.gone_id) for r in kept.collect()} == {(1, "a b c d e", 3), (2, "", 4), (None, "x y z", 5)}


def test_long_lines_are_split_by_bytes(spark):
    rows = [(a, 1 + a, 7) for a in range(300)]
    pairs = spark.createDataFrame(rows, "a long, b long, word int")
    ends = spark.createDataFrame([(7, k, 1000) for k in range(301)], "word int, lo long, bytes long")
    dealt, needed = m.verify_parts(pairs, 10_000, ends, most=60_000)
    assert sorted(r[1:] for r in map(tuple, dealt.collect())) == sorted(r[:2] for r in rows)
    assert max(Counter(r["part"] for r in needed.collect()).values()) < 200


def near_copies(seed, copies):
    """Copies of three lines, edited in up to nine words, and lines of two copies in one."""
    rng = random.Random(seed)
    kinds = [[f"{k}x{i}" for i in range(n)] for k, n in (("a", 20), ("b", 35), ("c", 12))]
    kinds.append(kinds[1][:30] + [f"d{i}" for i in range(6)])
    made = []
    for _ in range(copies):
        words = list(rng.choice(kinds))
        for _ in range(min(rng.randrange(10), rng.randrange(10))):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice(([], ["new"], [f"n{rng.randrange(40)}"], [words[at], f"n{rng.randrange(400)}"]))
        made.append(" ".join(words + (rng.choice(kinds) if rng.random() < 0.05 else [])))
    return [(i if i % 11 else None, "\n".join(made[k : k + 4])) for i, k in enumerate(range(0, copies, 4))]


@pytest.mark.parametrize("similarity", [Fraction(4, 5), Fraction(2, 3), Fraction(9, 10)])
def test_groups_around_centres_against_brute_force(spark, monkeypatch, similarity):
    monkeypatch.setattr(m, "GROUP", 8)
    monkeypatch.setattr(m, "CENTRE_SETS", 7)
    rows = near_copies(17, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(m.similar_lines(docs, similarity=similarity)) == plain(rows, similarity)


@pytest.mark.parametrize("vocabulary", [12, 60])
def test_poor_centres_change_nothing(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(m, "GROUP", 2)
    monkeypatch.setattr(m, "_CENTRE_WORDS", 50)
    rows = varied(vocabulary, 300, [f"w{i}" for i in range(vocabulary)])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(m.similar_lines(docs)) == plain(rows)


def test_near_copies_are_not_met_in_pairs(spark):
    base = [f"w{i}" for i in range(40)]
    pairs = {}
    for copies in (300, 1200):
        rng = random.Random(copies)
        rows = []
        for i in range(copies):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(40)] = f"n{rng.randrange(10 * copies)}"
            rows.append((i, " ".join(words)))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        lines = m.line_sets(docs, m.rarity(docs, "text"), "doc_id", "text", m.SIMILARITY)
        sets = lines.groupBy("hi", "lo").agg(F.min("id").alias("id"), F.min("line").alias("line"))
        home = m.homes(lines, m.SIMILARITY)
        texts = m.texts_at(docs, sets.join(home, "lo"), "doc_id", "text")
        found, visits = m.candidates(lines, m.SIMILARITY, m.clusters(texts, m.SIMILARITY))
        pairs[copies] = found.count(), visits.count()
    assert all(n <= copies and visited <= 2 * copies for copies, (n, visited) in pairs.items())
