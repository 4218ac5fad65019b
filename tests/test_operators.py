"""Operators on small hand-written tables."""

from __future__ import annotations

import itertools
import math
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake import schemas
from feedlake.operators import (
    catalog,
    dedup,
    deliveries,
    entries,
    insights,
    ranking,
    summaries,
    validation,
)


def run_date():
    return F.lit("2023-02-01").cast("timestamp")


def as_of():
    return F.lit("2023-01-10").cast("timestamp")


def entry(order, **fields):
    row = {f.name: None for f in schemas.ENTRY.fields}
    row.update(fields, source_id=1, feed_order=order)
    return row


def entry_frame(spark, rows):
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            *schemas.ENTRY.fields,
            T.StructField("source_id", T.LongType()),
            T.StructField("feed_order", T.LongType()),
        ]
    )
    return spark.createDataFrame(rows, schema)


NEAR_DUPLICATES = [
    entry(1, title="AI Breakthrough", link="https://e.com/ai", description="<p>A new  model</p>",
          tags=["AI", "Tech"], published="Mon, 15 Jan 2023 10:00:00 GMT"),
    entry(2, title="  ai   breakthrough ", link="https://E.com/ai/?utm_source=rss",
          description="A new model", tags=["tech", "ai"], published="2023-01-15T10:00:00Z"),
    entry(3, title="<b>AI</b> Breakthrough", link="https://e.com/ai#top",
          description="A <i>new</i>\nmodel", published="Sun, 15 Jan 2023 05:00:00 -0500"),
    entry(4, title="Other story", link="https://e.com/other", description="Text",
          published="Mon, 15 Jan 2023 11:00:00 GMT"),
    entry(5, title="Third story", link="https://e.com/third", summary="", updated="2023-01-16"),
]


def test_near_duplicate_entries_collapse_to_three(spark):
    rows = entries.map_articles(entry_frame(spark, NEAR_DUPLICATES), run_date())
    kept = dedup.first_wins(rows, "content_hash", ["feed_order"]).orderBy("feed_order").collect()
    assert [r.feed_order for r in kept] == [1, 4, 5]
    assert kept[0].tags == ["AI", "Tech"]
    assert kept[0].title == "AI Breakthrough"
    assert kept[2].published_at == datetime(2023, 1, 16)


@pytest.mark.parametrize("profile", entries.PROFILES)
def test_undated_entries(spark, profile):
    frame = entry_frame(spark, [entry(1, title="T", link="https://e.com/a")])
    days = [F.lit(d).cast("timestamp") for d in ("2023-02-01 08:00:00", "2023-02-02")]
    rows = [entries.map_articles(frame, day, profile).first() for day in days]
    assert rows[0].published_at == datetime(2023, 2, 1)
    assert rows[0].is_fallback_date
    same = rows[0].content_hash == rows[1].content_hash
    assert same == (profile != "compat")


def test_profiles_differ_where_documented(spark):
    frame = entry_frame(
        spark,
        [
            entry(1, title="a &lt;b&gt; c", link="https://e.com/a?ref=x&b=1&a=2",
                  description="&lt;script&gt;go()&lt;/script&gt; condition= x <script>y()</script>")
        ],
    )
    got = {p: entries.map_articles(frame, run_date(), p).first() for p in entries.PROFILES}
    assert got["strict"].summary_raw == "condition= x"
    assert got["compat"].summary_raw == "<script>go()</script> c x y()"
    assert got["legacy"].summary_raw == "scriptgo()/script c x y()"
    assert got["strict"].title == got["compat"].title == "a c"
    assert got["legacy"].title == "a b c"
    assert got["strict"].link == "https://e.com/a?a=2&b=1&ref=x"
    assert got["legacy"].link == "https://e.com/a?b=1&a=2"
    assert len({r.content_hash for r in got.values()}) == 3


def test_compat_hash_decodes_twice(spark):
    frame = entry_frame(
        spark,
        [entry(i, title=t, link="https://e.com/a", published="2023-01-15") for i, t in
         enumerate(["x &amp;lt;b&amp;gt; y", "x y"])],
    )
    compat = [r.content_hash for r in entries.map_articles(frame, run_date(), "compat").collect()]
    strict = [r.content_hash for r in entries.map_articles(frame, run_date()).collect()]
    assert compat[0] == compat[1]
    assert strict[0] != strict[1]


def test_hostile_entries(spark):
    frame = entry_frame(
        spark,
        [
            entry(1, title="<script>alert('x')</script>News", link="https://e.com/1",
                  description="<iframe src=x></iframe><object>o</object>Safe",
                  author="<img src=x onerror=alert(1)>Eve"),
            entry(2, title="'; DROP TABLE articles; --", link="https://e.com/2",
                  description="x; DELETE FROM users; -- y"),
        ],
    )
    one, two = entries.map_articles(frame, run_date()).orderBy("feed_order").collect()
    assert (one.title, one.summary_raw, one.author) == ("News", "oSafe", "Eve")
    assert "DROP TABLE" not in two.title and "--" not in two.title
    assert "DELETE" not in two.summary_raw and "--" not in two.summary_raw


def test_article_validation(spark):
    good = ("t", "https://e.com", "a" * 64, datetime(2023, 1, 1), 1, ["x"])
    bad = (" \n", None, "short", None, 0, [None])
    long = ("t" * 513, "javascript:x", "a" * 64, datetime(2023, 1, 1), 1, None)
    schema = "title string, link string, content_hash string, published_at timestamp, source_id long, tags array<string>"
    frame = spark.createDataFrame([good, bad, long], schema)
    frame = frame.withColumn("author", F.lit(None).cast("string"))
    rows = validation.validate_articles(frame, check_lengths=True).collect()
    assert rows[0].violations == [] and rows[0].link_scheme_ok
    assert rows[1].violations == ["source_id", "title", "link", "content_hash", "published_at", "tags"]
    assert rows[2].violations == ["tags", "title_too_long"] and not rows[2].link_scheme_ok
    checked = validation.validate_articles(frame)
    assert validation.accepted(checked).count() == 1
    assert validation.rejected(checked).count() == 2


def test_null_tags_are_no_violation_when_empty(spark):
    rows = entries.map_articles(entry_frame(spark, [entry(1, title="t", link="https://e.com")]), run_date())
    assert validation.validate_articles(rows).first().violations == []


def test_source_validation(spark):
    frame = spark.createDataFrame(
        [("n", "u", "f", 0.0), (" ", None, "f", 1.5), ("n", "u", "f", None)],
        "name string, url string, feed_url string, credibility_score double",
    )
    checked = validation.validate_sources(frame)
    assert [r.violations for r in checked.collect()] == [
        [],
        ["name", "url", "credibility_score"],
        [],
    ]
    with pytest.raises(PySparkException, match="invalid row"):
        validation.require_valid(checked).count()
    assert validation.require_valid(checked.filter("name = 'n'")).count() == 2


def test_run_counters_with_one_hot_hash(spark):
    rows = [(i, "hot", "f1" if i % 2 else "f2", []) for i in range(1000)]
    rows += [(1000, "cold", "f1", []), (1001, "stored", "f2", []), (1002, "bad", "f2", ["title"])]
    rows += [(1003, "hot", "f3", []), (1004, "mixed", "f3", ["title"]), (1005, "mixed", "f3", [])]
    frame = spark.createDataFrame(rows, "o long, content_hash string, feed string, violations array<string>")
    existing = spark.createDataFrame([("stored",), ("stored",)], "content_hash string")
    got = {
        r.feed: (r.parsed, r.inserted, r.skipped, r.errors)
        for r in dedup.run_counters(frame, existing, "feed", "o").collect()
    }
    assert got == {"f1": (501, 1, 500, 0), "f2": (502, 1, 500, 1), "f3": (3, 1, 1, 1)}


def test_unique_and_foreign_keys(spark):
    tables = {
        "users": spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, email string"),
        "topics": spark.createDataFrame([(1, 1), (2, 9), (3, 9), (4, None)], "id long, user_id long"),
    }
    got = sorted((r["constraint"], r.key, r.n_rows) for r in dedup.audit_tables(tables).collect())
    assert got == [("topics.user_id", "9", 2), ("users(email)", "a", 2)]


def test_upsert_keeps_identity_and_zero_scores(spark):
    at = datetime(2023, 1, 1)
    stored = spark.createDataFrame(
        [
            (7, "old", "u1", "f1", 0.5, True, at, "boom", 3, at, at),
            (8, "same", "u2", "f2", 0.5, True, None, None, 0, at, at),
            (9, "kept", "u3", "f3", 0.9, False, None, None, 0, at, at),
        ],
        "id long, name string, url string, feed_url string, credibility_score double, "
        "is_active boolean, last_fetched_at timestamp, last_error string, error_count int, "
        "created_at timestamp, updated_at timestamp",
    )
    seeds = spark.createDataFrame(
        [("x", "u1", "f1", 0.1, True, 1), ("new", "u1", "f1", 0.0, None, 2),
         ("same", "u2", "f2", 0.5, True, 3), ("fresh", "u4", "f4", None, None, 4)],
        "name string, url string, feed_url string, credibility_score double, is_active boolean, o long",
    )
    result = catalog.upsert_sources(stored, catalog.last_seed_wins(seeds, "o"), run_date())
    rows = {r.feed_url: r for r in result.collect()}
    run = datetime(2023, 2, 1)
    assert (rows["f1"].id, rows["f1"].name, rows["f1"].credibility_score) == (7, "new", 0.0)
    assert (rows["f1"].error_count, rows["f1"].last_error) == (3, "boom")
    assert (rows["f1"].created_at, rows["f1"].updated_at) == (at, run)
    assert (rows["f2"].action, rows["f2"].updated_at) == ("updated", at)
    assert (rows["f3"].action, rows["f3"].is_active) == ("untouched", False)
    assert (rows["f4"].action, rows["f4"].credibility_score, rows["f4"].is_active) == ("created", 0.5, True)
    assert rows["f4"].id > 0 and rows["f4"].created_at == run
    counts = catalog.seed_counters(result).first()
    assert (counts.created, counts.updated, counts.skipped) == (1, 2, 0)
    assert [r.url for r in catalog.url_clashes(seeds).collect()] == ["u1"]


def test_placeholders(spark):
    wanted = spark.createDataFrame([("f1", None), ("f1", None), ("f2", "Named"), ("f3", None)], "feed_url string, name string")
    known = spark.createDataFrame([("f3",)], "feed_url string")
    rows = {r.feed_url: r for r in catalog.placeholder_sources(wanted, known, run_date()).collect()}
    assert set(rows) == {"f1", "f2"}
    assert rows["f1"].name == "Unknown Source (f1)" and rows["f2"].name == "Named"
    assert not rows["f1"].is_active and rows["f1"].credibility_score == 0.5


def test_source_health_agrees_with_a_sequential_fold(spark):
    import random

    rng = random.Random(3)
    runs = [
        (rng.choice([1, 1, 1, 2, 3]), i, datetime(2023, 1, 1, rng.randrange(24), rng.randrange(60)),
         rng.random() < 0.4, "e" * 1200 if i % 2 else f"err{i}")
        for i in range(300)
    ]
    runs += [(4, 900, datetime(2023, 1, 1), False, "only"), (5, 901, datetime(2023, 1, 1), True, None)]
    expected = {}
    for source, run, ts, ok, error in sorted(runs, key=lambda r: (r[2], r[1])):
        state = expected.setdefault(source, [None, 0, None])
        if ok:
            state[:] = [ts, 0, None]
        else:
            state[1:] = [state[1] + 1, error[:1000]]
    frame = spark.createDataFrame(runs, "source_id long, run_id long, ts timestamp, ok boolean, error string")
    health = catalog.source_health(frame)
    got = {r.source_id: [r.last_fetched_at, r.error_count, r.last_error] for r in health.collect()}
    assert got == expected

    stored = spark.createDataFrame(
        [(i, True, None, "old", 2, datetime(2022, 1, 1)) for i in (4, 5, 6)],
        "id long, is_active boolean, last_fetched_at timestamp, last_error string, error_count int, updated_at timestamp",
    )
    folded = catalog.auto_deactivate(catalog.apply_health(stored, health, run_date()), after=3)
    rows = {r.id: (r.error_count, r.last_error, r.is_active) for r in folded.collect()}
    assert rows == {4: (3, "only", False), 5: (0, None, True), 6: (2, "old", True)}
    assert catalog.auto_deactivate(folded, 0) is folded


def test_fair_sources(spark):
    frame = spark.createDataFrame(
        [(1, True, datetime(2023, 1, 31)), (2, True, None), (3, False, None), (4, True, None),
         (5, True, datetime(2023, 1, 31, 23, 59, 30)), (6, True, datetime(2023, 1, 30))],
        "id long, is_active boolean, last_fetched_at timestamp",
    )
    picked = catalog.fair_sources(frame, run_date(), C.BatchSettings(source_limit=4)).collect()
    assert [r.id for r in picked] == [2, 4, 6, 1]


def test_lookups(spark):
    sources = spark.createDataFrame([(1, "f1"), (2, "f2")], "id long, feed_url string")
    assert catalog.source_by_id(sources, 2).first().feed_url == "f2"
    assert catalog.source_by_feed_url(sources, "nope").count() == 0
    wanted = spark.createDataFrame([(1,), (9,)], "id long")
    found = {r.id: r.found for r in catalog.lookup_sources(sources, wanted, "id").collect()}
    assert found == {1: True, 9: False}


def articles_frame(spark, rows):
    return spark.createDataFrame(
        rows, "article_id long, source_id long, title string, body string, published_at timestamp"
    )


def topics_frame(spark, rows):
    return spark.createDataFrame(rows, "topic_id long, keywords array<string>")


def test_keyword_score(spark):
    articles = articles_frame(
        spark,
        [
            (1, 1, "Solar power", "The power of wind.", datetime(2023, 1, 9)),
            (2, 1, "Wind", "solarpower and nothing else", datetime(2023, 1, 9)),
            (3, 1, "Machine, learning", "machine learning! machine", datetime(2023, 1, 9)),
            (4, 1, "", "", datetime(2023, 1, 9)),
        ],
    )
    topics = topics_frame(spark, [(1, ["Power", "power", "the"]), (2, ["machine learning"]), (3, ["solar"])])
    got = {(r.topic_id, r.article_id): r.relevance for r in ranking.keyword_score(articles, topics).collect()}
    assert got == {
        (1, 1): round((2 + 1) / 6, 6),
        (2, 3): round((2 + 1) / 5, 6),
        (3, 1): round(2 / 6, 6),
    }


def test_tfidf_is_a_cosine(spark):
    texts = {1: "cat cat dog", 2: "dog bird", 3: "fish"}
    articles = articles_frame(spark, [(i, 1, t, "", datetime(2023, 1, 9)) for i, t in texts.items()])
    topics = topics_frame(spark, [(1, ["cat", "dog", "unicorn"])])
    got = {r.article_id: r.relevance for r in ranking.tfidf_score(articles, topics).collect()}

    counts = {i: {w: t.split().count(w) for w in t.split()} for i, t in texts.items()}
    idf = {
        w: math.log((1 + 3) / (1 + sum(w in c for c in counts.values()))) + 1
        for w in set(itertools.chain(*counts.values()))
    }
    topic = {w: idf[w] for w in ("cat", "dog")}

    def cosine(doc):
        vector = {w: n * idf[w] for w, n in doc.items()}
        dot = sum(vector.get(w, 0) * v for w, v in topic.items())
        norm = lambda x: math.sqrt(sum(v * v for v in x.values()))
        return round(dot / norm(vector) / norm(topic), 6)

    assert got == {1: cosine(counts[1]), 2: cosine(counts[2])}
    frozen = ranking.idf_snapshot(ranking.term_counts(articles), articles)
    again = ranking.tfidf_score(articles, topics, frozen)
    assert {r.article_id: r.relevance for r in again.collect()} == got


def test_recency_halves_and_never_exceeds_one(spark):
    frame = spark.createDataFrame(
        [(datetime(2023, 1, 10),), (datetime(2023, 1, 8),), (datetime(2023, 1, 6),), (datetime(2023, 1, 11),)],
        "p timestamp",
    )
    got = [round(r[0], 9) for r in frame.select(ranking.recency_boost(F.col("p"), as_of())).collect()]
    assert got == [1.0, 0.5, 0.25, 1.0]


def test_ranking_ties_and_window(spark):
    day = datetime(2023, 1, 9)
    rows = [(i, 1, "wind", "", day) for i in (3, 1, 2)]
    rows += [(4, 1, "wind", "", datetime(2023, 1, 9, 12)), (5, 1, "wind", "", datetime(2022, 12, 1))]
    rows += [(6, 2, "wind", "", day)]
    articles = articles_frame(spark, rows)
    topics = topics_frame(spark, [(1, ["wind"])])
    ranked = ranking.rank_articles(articles, topics, as_of()).orderBy("rank").collect()
    assert [r.article_id for r in ranked] == [4, 1, 2, 3, 6]
    sources = spark.createDataFrame([(2, 1.0), (1, 0.0)], "id long, credibility_score double")
    best = ranking.rank_articles(articles, topics, as_of(), sources=sources).orderBy("rank").first()
    assert best.article_id == 6
    with pytest.raises(ValueError):
        ranking.rank_articles(articles, topics, as_of(), mode="other")


def test_daily_picks_never_repeat_and_stay_frozen(spark):
    scored = spark.createDataFrame(
        [(1, i, 1.0 - i / 10, datetime(2023, 1, 9)) for i in range(5)] + [(2, 0, 0.5, datetime(2023, 1, 9))],
        "topic_id long, article_id long, score double, published_at timestamp",
    )
    nothing = spark.createDataFrame([], "topic_id long, article_id long, delivery_date date")
    days = [F.lit(date(2023, 1, d)) for d in (9, 10)]
    columns = ["topic_id", "article_id", "delivery_date"]
    first = deliveries.daily_picks(scored, nothing, days[0])
    got = sorted((r.topic_id, r.position, r.article_id) for r in first.collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 0)]
    past = first.select(*columns)
    assert deliveries.daily_picks(scored, past, days[0]).count() == 0
    second = deliveries.daily_picks(scored, past, days[1])
    assert sorted((r.topic_id, r.position, r.article_id) for r in second.collect()) == [(1, 1, 3), (1, 2, 4)]
    topics = topics_frame(spark, [(1, []), (2, []), (3, [])])
    short = {r.topic_id: r.n_picks for r in deliveries.short_topics(first, topics).collect()}
    assert short == {2: 1, 3: 0}


def test_feedback_learning_moves_rankings(spark):
    rated = spark.createDataFrame(
        [(1, ["wind", "wind", "sun"], True), (1, ["wind"], True), (1, ["sun", "rain"], False)],
        "topic_id long, terms array<string>, up boolean",
    )
    old = spark.createDataFrame([(1, "wind", 4.9), (1, "snow", 2.0)], "topic_id long, term string, weight double")
    got = {r.term: (r.ups, r.downs, round(r.weight, 6)) for r in deliveries.keyword_weights(rated, old).collect()}
    assert got == {"wind": (2, 0, 5.0), "sun": (1, 1, 1.0), "rain": (0, 1, 0.9), "snow": (0, 0, 2.0)}
    latest = deliveries.latest_feedback(
        spark.createDataFrame([(1, 1, "up"), (1, 2, "down"), (2, 1, "up")], "d long, t long, rating string"),
        "d", ["t"],
    )
    assert {r.d: r.rating for r in latest.collect()} == {1: "down", 2: "up"}


def test_running_total_crosses_blocks(spark):
    rows = [("hot", i * 3, (i * 7) % 5) for i in range(500)] + [("cold", 1, 9)]
    frame = spark.createDataFrame(rows, "k string, o long, v long")
    got = {
        (r.k, r.o): r.t
        for r in summaries.running_total(frame, ["k"], "o", "v", "t").collect()
    }
    expected, total = {("cold", 1): 9}, 0
    for _, o, v in rows[:-1]:
        total += v
        expected[("hot", o)] = total
    assert got == expected


def test_summary_checks(spark):
    frame = spark.createDataFrame(
        [("One. Two! Three?",), ("One only",), ("A. B. C. D.",), ("...",)], "s string"
    )
    got = [(r.n_sentences, r.status, r.stored_text) for r in summaries.check_summaries(frame, "s").collect()]
    assert got == [
        (3, "valid", "One. Two! Three?"),
        (1, "too_short", "One only"),
        (4, "truncated", "A. B. C."),
        (0, "too_short", "..."),
    ]
    distribution = summaries.status_distribution(summaries.check_summaries(frame, "s"))
    assert {r.status: r.n for r in distribution.collect()} == {"valid": 1, "too_short": 2, "truncated": 1}


def test_near_duplicates_against_brute_force(spark):
    """Families that drift word by word, a hot family and exact copies: all pairs count."""
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for family in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        for _ in range(25 if family == 0 else 5):
            docs.append((len(docs), " ".join(words)))
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    docs += [(500, "tiny"), (501, "tiny"), (502, ""), (503, docs[3][1]), (504, docs[3][1])]

    def grams(text):
        w = text.split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {text}

    sets = {i: grams(t) for i, t in docs}
    want = {}
    for doc in sets:
        scored = [(len(sets[doc] & sets[o]) / len(sets[doc] | sets[o]), -o) for o in sets if o < doc]
        if scored and max(scored)[0] >= 0.8:
            want[doc] = (-max(scored)[1], round(max(scored)[0], 6))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    links = {r.doc_id: (r.duplicate_of, r.jaccard) for r in insights.near_duplicates(frame).collect()}
    assert links == want and len(want) > 60


def test_phrases_of_any_length(spark):
    articles = spark.createDataFrame(
        [(1, "On large language model training", "a large language model and large language x")],
        "article_id long, title string, body string",
    )
    topics = spark.createDataFrame(
        [(1, ["large language model"]), (2, ["large language"]), (3, ["large language model training a large"]), (4, ["no"])],
        "topic_id long, keywords array<string>",
    )
    got = {r.topic_id: r.relevance for r in ranking.keyword_score(articles, topics).collect()}
    assert got == {1: round(3 / 13, 6), 2: round(4 / 13, 6)}


def test_delays_keep_seconds(spark):
    rows = [(datetime(2023, 1, 1), datetime(2023, 1, 1, 0, 0, 59)), (datetime(2023, 1, 1), datetime(2023, 1, 1, 0, 0, 59))]
    frame = spark.createDataFrame(rows, "published_at timestamp, delivered_at timestamp")
    timed = insights.time_to_delivery(frame, F.lit("all").alias("topic")).first()
    assert round(timed.p50_hours * 3600, 6) == 59


def test_adjacent_topics(spark):
    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, "b"), (3, "c"), (4, "a"), (4, "c")]
    got = {
        (r.topic_a, r.topic_b): (r.shared_users, round(r.lift, 6))
        for r in insights.adjacent_topics(spark.createDataFrame(rows, "user_id long, topic string")).collect()
    }
    assert got == {("a", "b"): (2, round(2 * 4 / (3 * 2), 6)), ("a", "c"): (1, round(4 / 6, 6))}


def test_kpis_and_drift(spark):
    rows = [
        (datetime(2023, 1, 5, 1), 1, "a", "x", True, False),
        (datetime(2023, 1, 5, 2), 1, "a", "x", True, False),
        (datetime(2023, 1, 5, 3), 2, "b", "y", False, True),
        (datetime(2023, 1, 12, 3), 2, "b", "y", False, True),
    ]
    frame = spark.createDataFrame(
        rows,
        "ts timestamp, user_id long, topic string, article_id string, is_view boolean, is_interaction boolean",
    )
    kpis = {r.day.day: r for r in insights.kpi_daily(frame).collect()}
    assert (kpis[5].active_users, kpis[5].events, kpis[5].interaction_rate) == (2, 3, 0.5)
    assert round(kpis[5].repeat_rate, 6) == round(1 / 3, 6)
    assert kpis[12].interaction_rate is None
    drift = {(r.window_start.day, r.topic): r.drift for r in insights.interest_drift(frame).collect()}
    assert round(drift[(12, "b")], 6) == round(1 - 1 / 3, 6) and drift[(5, "a")] is None
