"""Mixing against DuckDB SQL on skewed tables, its budgets, and odd rows."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from feedlake.llm import mixing as m
from feedlake.llm import sqltext

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, n_tokens string, pass string"


def skewed(seed=1, sizes=(400, 60, 30, 9, 2)):
    rng = random.Random(seed)
    rows = []
    for k, size in enumerate(sizes):
        for _ in range(size):
            rows.append((len(rows), "w " * rng.randrange(1, 40), "en", f"s{k}", 1, "x", "x", "x"))
    return rows


def odd_rows():
    rows = skewed(2, (90, 20))
    rows += [(None, "no id", "en", "s0", 1, None, None, None), (None, "no id either", "en", "s0", 1, None, None, None)]
    rows += [(900, None, None, None, None, None, None, None), (901, "", "en", "", 1, "x", "x", "x"), (902, "  ", "en", "blank", 1, "x", "x", "x")]
    rows += [rows[0], rows[0], (rows[1][0], "other words", "en", "s0", 1, "x", "x", "x"), (5, "elsewhere", "en", "s1", 1, "x", "x", "x")]
    rows += [(950, "long " * 50_000, "en", "long", 1, "x", "x", "x")]
    return rows


@pytest.mark.parametrize("rows", [skewed(), odd_rows(), skewed(3, (50,))])
def test_query_matches_sql(spark, rows):
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.execute(sqltext.SQL["op7_mixing"]).fetchall()
    docs = spark.createDataFrame(rows, SCHEMA)
    target = m.Target(sqltext.MIX_ENTROPY, sqltext.MIX_REPEATS)
    got = [tuple(r) for r in m.mix(docs, target).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    rebuilt = m.mixed(docs, target)
    assert rebuilt.columns[:8] == docs.columns
    copies = {}
    for r in rows:
        key = (r[0], r[3] or "")
        # Texts without an id differ here, so each is a unit.
        copies[key] = 1 if r[0] is None else copies.get(key, 0) + 1
    assert rebuilt.count() == sum(copies[r[0], r[1]] for r in got)


def test_budgets_and_order(spark):
    docs = spark.createDataFrame(skewed(), SCHEMA)
    got = m.mix(docs, m.Target(entropy=0.8, repeats=3.0)).toPandas()
    planned = m.plan(m.units(docs, "doc_id", "text", "source"), m.Target(0.8, 3.0)).toPandas().set_index("source")
    spent = got.groupby("source")["n_tokens"].sum()
    assert ((spent - planned["budget"]) >= 0).all()
    assert ((spent - planned["budget"]) < 40).all()
    assert planned["weight"].sum() == pytest.approx(1)
    assert (planned["budget"] / planned["n_tokens"]).max() <= 3.01
    # Each pass but the last holds every document of its source once.
    for source, group in got.groupby("source"):
        for p in range(1, int(planned.loc[source, "passes"]) + 1):
            assert group[group["pass"] == p]["id"].nunique() == planned.loc[source, "n_units"]
    ordered = got.sort_values(["order_key", "id"])
    assert (ordered.groupby(["order_key"])["block"].nunique() == 1).all()


@pytest.mark.parametrize(("entropy", "repeats"), [(0.9, None), (None, 2.0), (0.99, 1.5), (None, None), (2.0, None)])
def test_exponent(spark, entropy, repeats):
    p = np.array([0.7, 0.2, 0.06, 0.04])
    shares = spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(p)], "source string, share double")
    a = m.exponent(shares, m.Target(entropy, repeats))

    def weights(x):
        return p**x / (p**x).sum()

    def holds(x):
        w = weights(x)
        return (entropy is None or repeats is not None or -(w * np.log(w)).sum() >= entropy * np.log(4) - 1e-5) and (
            repeats is None or (w / p).max() <= repeats + 1e-4
        )

    if entropy != 2.0:
        assert holds(a)
    else:
        assert a <= 1e-6
    if entropy is None and repeats is None:
        assert a == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert m.mix(empty, m.Target(0.9, 4.0)).count() == 0
    assert m.mixed(empty, m.Target(0.9, 4.0)).count() == 0


@pytest.mark.parametrize("budget", [400, 2000, 50_000])
def test_every_source_is_within_a_unit_of_its_budget(spark, budget):
    """Also a source whose texts are longer than its budget."""
    rows = [(k, "w " * n, "en", s, 1, "x", "x", "x") for k, (n, s) in enumerate([(700, "big")] * 5 + [(400, "mid")] * 7 + [(3, "small")] * 400)]
    rows += [(None, f"w{k} " * 20, "en", "nameless", 1, "x", "x", "x") for k in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = m.Target(entropy=0.99)
    planned = m.plan(m.units(docs, "doc_id", "text", "source"), target, budget).toPandas().set_index("source")
    got = m.mix(docs, target, budget).toPandas()
    spent = got.groupby("source")["n_tokens"].sum()
    longest = {"big": 700, "mid": 400, "small": 3, "nameless": 20}
    for source, most in longest.items():
        assert 0 <= spent[source] - planned.loc[source, "budget"] < most
    assert planned["budget"].sum() == pytest.approx(budget, abs=3)


def test_columns_of_the_mixture_replace_others(spark):
    rows = [(1, "a b", "s", "old", 7, 8), (2, "c", "t", "old", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Mix_Pass string, order_key int, unit_key int")
    found = m.mixed(docs, m.Target(0.5))
    assert found.columns == ["doc_id", "text", "source", "unit_key", "mix_pass", "order_key"]
    assert {(r.doc_id, r.unit_key) for r in found.collect()} == {(1, 8), (2, 8)}
