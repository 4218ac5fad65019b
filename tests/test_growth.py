"""Shapes that large tables take: plans without broadcasts, keys in few or many parts."""

from __future__ import annotations

import math
import re
from contextlib import contextmanager

from pyspark.sql import functions as F

from feedlake.operators import insights, networks, ranking
from feedlake.session import gathered, materialize
from feedlake.sources import feeds


@contextmanager
def settings(spark, **pairs):
    """Session settings for a while; names have _ for dots."""
    held = {k.replace("_", "."): v for k, v in pairs.items()}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_neighbouring_topics_without_broadcasts(spark):
    """Joins of large sides: a union of joined rows once failed behind them."""
    likes = [(u, f"t{t}") for u in range(20) for t in range(6) if (u * 7 + t) % 3]
    terms = [(f"t{t}", f"w{w}") for t in range(6) for w in range(40) if (w * 5 + t) % 4]
    terms += [(f"t{t}", f"own{t}") for t in range(6)]

    def found():
        rows = insights.neighbouring_topics(
            spark.createDataFrame(likes, "user_id long, topic string"),
            spark.createDataFrame(terms, "topic string, term string"),
        )
        return sorted(map(tuple, rows.collect()))

    with settings(spark, spark_sql_autoBroadcastJoinThreshold="-1"):
        merged = found()
    assert len(merged) == 30
    assert merged == found()


def plan_of(rows):
    return rows._jdf.queryExecution().toString()


def percentile(values, share):
    values = sorted(values)
    place = (len(values) - 1) * share
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high


def test_delays_are_exact_and_in_no_single_task(spark):
    """Null keys, null and negative delays, equal delays, delays of years."""
    micros = {
        "a": [7 * i * i * 1_000_003 for i in range(300)],
        "b": [-5, -5, 3, 2**32, 2**32 + 1, 2**47, 2**47 + 2**16],
        None: [1, 2, 10, 2**16, 2**16 + 1],
        "one": [-(2**33)],
        "none": [],
    }
    rows = [(k, d) for k, ds in micros.items() for d in [*ds, None]]
    start = F.timestamp_micros(F.lit(0).cast("long"))
    given = spark.createDataFrame(rows, "topic string, d long").select(
        "topic", start.alias("published_at"), F.timestamp_micros("d").alias("delivered_at")
    )
    found = insights.time_to_delivery(given, "topic")
    assert "percentile(" not in plan_of(found)
    got = {r.topic: (r.n, r.p50_hours, r.p95_hours) for r in found.collect()}
    assert set(got) == set(micros)
    for k, ds in micros.items():
        assert got[k][0] == len(ds) + 1
        for share, hours in zip((0.5, 0.95), got[k][1:], strict=True):
            assert hours == (percentile(ds, share) / 3_600_000_000 if ds else None)
    whole = insights.time_to_delivery(given).collect()
    everything = [d for ds in micros.values() for d in ds]
    assert [(r.n, r.p50_hours) for r in whole] == [(len(rows), percentile(everything, 0.5) / 3_600_000_000)]


def test_items_go_without_their_file(spark):
    texts = spark.createDataFrame(
        [(1, "<rss>h<item>a</item><item>b</item></rss>"), (2, "no items"), (3, "<item>c</item>"), (4, None), (5, "")],
        "f int, text string",
    )
    items = feeds.split_items(texts).drop("text")
    carried = re.findall(r"Generate posexplode\w*\([^)]*\), \[([^\]]*)\]", plan_of(items))
    assert carried and not any("text" in c or "_pieces" in c for c in carried[-1:])
    got = sorted((r.f, -1 if r.ordinal is None else r.ordinal, r["head"], r.xml) for r in items.collect())
    assert got == [
        (1, 0, "<rss>h", "<item>a</item>"), (1, 1, None, "<item>b</item>"), (2, -1, "no items", None),
        (3, 0, "", "<item>c</item>"), (4, -1, "", None), (5, -1, "", None),
    ]


def test_hosts_are_folded_in_parts_that_grow_in_number(spark):
    hosts = spark.createDataFrame([("10.1.2.3",), ("10.1.2.3",), ("10.9.9.9",), (None,), ("x",)], "host string")
    listed = spark.createDataFrame([("10.0.0.0/8",), ("10.1.0.0/16",)], "network string")
    found = networks.longest_network(hosts, listed)
    assert "REPARTITION_BY_NUM" in plan_of(found)
    assert sorted(map(tuple, found.collect())) == [("10.1.2.3", "10.1.0.0/16"), ("10.9.9.9", "10.0.0.0/8")]


def words_of(spark, n=40):
    # Articles 0 and 1 come in two rows; one has no id.
    rows = [(None if i == n else i % n, f"all w{i % 7} t{i}", f"all w{i % 3} b{i // 2}") for i in range(n + 2)]
    return spark.createDataFrame(rows, "article_id long, title string, body string")


def test_words_are_counted_where_the_article_lies(spark):
    articles = words_of(spark)
    there = gathered(articles, "article_id")
    topics = spark.createDataFrame([(1, ["all", "w1 t1"]), (2, ["b3", "all w2"])], "topic_id long, keywords array<string>")
    topics = materialize(topics, "topics")  # with a size known to be small
    assert there.rdd.getNumPartitions() >= 16 * articles.rdd.getNumPartitions()
    for counted in (
        lambda a: ranking.term_counts(a),
        lambda a: ranking.tokens(a).groupBy("field", "token", "article_id").count(),
        lambda a: ranking.keyword_score(a, topics),
    ):
        moved = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\), (\w+)", plan_of(counted(there))) if "article_id" in x[0]]
        assert moved and {x[1] for x in moved} == {"REPARTITION_BY_NUM"}
        assert sorted(map(str, counted(there).collect())) == sorted(map(str, counted(articles).collect()))


def test_common_and_rare_terms_give_the_same_scores(spark, monkeypatch):
    articles = words_of(spark)
    topics = spark.createDataFrame([(1, ["all", "w1", "t1"]), (2, ["b3", "w2"])], "topic_id long, keywords array<string>")
    scores = []
    for common in (1, 3, 500):
        monkeypatch.setattr(ranking, "COMMON_ONE_IN", common)
        scores.append(sorted(map(str, ranking.tfidf_score(articles, topics).collect())))
    assert scores[0] and scores[0] == scores[1] == scores[2]


def test_shingles_of_one_document_stay_with_it(spark):
    """Lists of (f, h) bring back the shared shingles alone; the order is rarest first."""
    rows = spark.createDataFrame(
        [(1, [1, 2, 3, 9], [(2, 9), (3, 1)]), (2, [4, 5], None)], "i int, s array<bigint>, shared array<struct<f:long,h:long>>"
    )
    got = rows.select("i", insights.rarest_first("s", "shared").alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [[2, 3, 9, 1], [4, 5]]
