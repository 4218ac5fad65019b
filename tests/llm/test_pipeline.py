"""The pipeline: each stage against a plain version on its own input."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline as p
from feedlake.llm import sqltext
from tests_llm_plain import plain_components, plain_kept_lines, plain_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [("documents", docs.toPandas())]
    for name, stage in p.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        tables.append((name, docs.toPandas()))
    return tables


def test_columns(stages):
    columns = list(stages[0][1].columns)
    assert all(list(t.columns) == columns for _, t in stages[:-1])
    assert list(stages[-1][1].columns) == [*columns, "mix_pass", "order_key"]


def test_quality_keeps_good_and_drops_bad(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = set(stages[1][1]["doc_id"])
    good, bad = set(labels[labels == 1].index), set(labels[labels == 0].index)
    assert len(good & kept) >= 0.97 * len(good)
    assert len(bad & kept) <= 0.3 * len(bad)
    whole = stages[0][1].set_index("doc_id")["text"]
    assert all(whole[r.doc_id] == r.text for r in stages[1][1].itertuples())


def test_line_dedup(stages):
    before, after = stages[1][1], stages[2][1].set_index("doc_id")
    want = plain_kept_lines(list(zip(before["doc_id"], before["text"], strict=True)))
    assert {i: after.loc[i, "text"] for i in before["doc_id"]} == want
    assert (after["n_chars"] == after["text"].str.len()).all()


def test_near_dedup(stages):
    before, after = stages[2][1], stages[3][1]
    items = [(r.doc_id, plain_simhash(r.text)) for r in before.itertuples()]
    want = set(plain_components(items, lambda x, y: (x ^ y).bit_count() <= 2).values())
    assert sorted(after["doc_id"]) == sorted(want)


def _sql(spark, sql, documents):
    con = duckdb.connect()
    con.register("documents", documents)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    return con.execute(sql).fetchall()


def test_decontamination(spark, stages):
    found = _sql(spark, sqltext.SQL["op5_decontaminate"], stages[3][1])
    assert sorted(stages[4][1]["doc_id"]) == sorted(r[0] for r in found if not r[-1])


def test_source_mix(spark, stages):
    want = _sql(spark, sqltext.SQL["op7_mixing"], stages[4][1])
    got = stages[5][1]
    assert sorted(zip(got["doc_id"], got["mix_pass"], got["order_key"], strict=True)) == sorted((r[0], r[3], r[5]) for r in want)


def test_run_equals_its_stages(spark, stages):
    got = p.run(spark, SF).toPandas()
    assert sorted(zip(got["doc_id"], got["mix_pass"], strict=True)) == sorted(
        zip(stages[-1][1]["doc_id"], stages[-1][1]["mix_pass"], strict=True)
    )


def test_stages_with_odd_and_no_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a few words", "en", "s", 11), (2, "", "en", "s", 0), (3, "long text " * 40_000, "en", "t", 400_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clashing = "line id key part __gone __kept kept_id gone_id unit_key hi lo word score simhash component n_tokens".split()
    docs = spark.createDataFrame([(*r, *clashing) for r in rows], schema + "".join(f", {c} string" for c in clashing))
    for name, stage in p.STAGES:
        found = stage(spark, docs, SF)
        assert found.columns[: len(docs.columns)] == docs.columns, name
        found.count()
        assert stage(spark, docs.where("false"), SF).count() == 0, name
