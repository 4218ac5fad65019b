"""Every registered query agrees with its SQL; plans keep their shape."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from feedlake import plans
from tools.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no supplied tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_matches_sql(spark, con, name):
    sql = plans.oracle_sql().get(name)
    ok, note = compare(spark, con, SF_DIR, name, plans.queries()[name], sql)
    assert ok, note


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_entry_registers_them():
    assert plans.queries().items() <= entry.queries().items()
    assert plans.oracle_sql().items() <= entry.oracle_sql().items()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["topic_id", "article_id", "score", "position", "delivery_date"]
    assert df.count() > 0


def plan_of(spark, name):
    df = plans.queries()[name](spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dedup_first_wins", "rank_topic_articles", "latest_feedback"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - {"stream_ingest", "stream_source_health", "near_duplicates_history"}))
def test_no_cartesian_products(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(spark, "source_performance")
    assert "html" not in plan and "text" not in plan
    assert "PushedFilters" in plan_of(spark, "needs_summary")


@pytest.mark.parametrize("name", ["quarantine_articles", "incremental_insert", "suspicious_content"])
def test_cleaning_is_not_copied_into_filters(spark, name):
    filters = [line for line in plan_of(spark, name).splitlines() if " Filter " in line]
    assert not any("fieldset" in line for line in filters)
