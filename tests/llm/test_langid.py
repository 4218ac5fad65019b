"""Mixture inference: counts, proportions, held-out accuracy and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from feedlake.llm import langid as g


@pytest.mark.parametrize("step", [1 << 20, 7, 16])
def test_blocks_do_not_change_counts(monkeypatch, step):
    text = "Été à la plage, 12 the  STRASSE ß " * 9
    want = [x.tolist() for x in g.grams(text)]
    monkeypatch.setattr(g, "STEP", step)
    assert [x.tolist() for x in g.grams(text)] == want
    words = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    size = len(words.encode())
    assert sum(want[1]) == sum(size - n + 1 for n in g.ORDERS)


def tables(spark):
    rng = np.random.default_rng(1)
    words = {"aa": "the of and ing tion was her".split(), "bb": "der die und ung keit ist sch".split(),
             "cc": "que los una ción por ado".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, text(lang, 120), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 8)]
    return rows, text


def test_mixture_and_odd_rows(spark):
    rows, text = tables(spark)
    rows += [(90, None, "aa"), (91, "words without a language", None), (92, "", "bb")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, score string, share double")
    model = g.learn(docs)
    assert model.languages == ["aa", "bb", "cc"]
    assert np.allclose(np.exp(model.logs.astype(float)).sum(axis=1), 1, atol=1e-3)
    named, score = g.proportions(model, text("bb", 80))
    assert [n for n, _ in named] == ["bb"] and score > 0.9
    named, score = g.proportions(model, text("aa", 200) + " " + text("cc", 100))
    assert [n for n, _ in named] == ["aa", "cc"]
    assert 0.5 < named[0][1] < 0.8 and sum(s for _, s in named) == pytest.approx(1)
    cases = [None, "", "123 %% ²", "the of and", "the " * 300_000, "日本語の文"]
    asked = spark.createDataFrame([(i, t, "zz", 1) for i, t in enumerate(cases)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r.f for r in asked.select("doc_id", g.languages(model, asked.text).alias("f")).collect()}
    assert [got[i].lang for i in range(5)] == ["und", "und", "und", "aa", "aa"]
    assert got[5].lang in model.languages
    assert all(0 <= f.score <= 1 for f in got.values())
    nothing = g.learn(docs.where("false"))
    assert {r.f.lang for r in asked.select(g.languages(nothing, asked.text).alias("f")).collect()} == {"und"}
    assert asked.where("false").select(g.languages(model, asked.text)).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(g, "MAX_LANGUAGES", 2)
    rows, _ = tables(spark)
    with pytest.raises(Exception, match="languages"):
        g.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_em_raises_likelihood():
    rng = np.random.default_rng(2)
    likely, counts = rng.random((3, 50)) + 0.01, rng.integers(1, 9, 50).astype(float)
    even = counts @ np.log(np.full(3, 1 / 3) @ likely)
    share, fit = g.mixture(likely, counts)
    assert fit >= even and share.sum() == pytest.approx(1)


def test_held_out_accuracy(spark):
    from feedlake.llm.queries import op8_language

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op8_language(spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
