"""Health and delays on streams, and sketches over longer periods."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedlake.operators import catalog, insights, periods
from feedlake.streaming.delays import late_rows, stream_delays
from feedlake.streaming.health import current_health, follow_health, stream_health

START = datetime(2023, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition keeps a state store per micro-batch; the rows are few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


RUN = "source_id long, run_id long, ts timestamp, ok boolean, error string"


def write_in_turn(spark, rows, schema, path, size):
    """One file per micro-batch, in the order given."""
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)


def drained(spark, path, schema, job, name, mode):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = job(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def fetch_log(n, rng, disorder):
    """Runs in order of arrival: times disturbed by up to ``disorder`` minutes."""
    rows = []
    for i in range(n):
        ts = START + timedelta(minutes=3 * i)
        source = rng.choice([1, 1, 1, 2, 3])
        ok = rng.random() < (0.02 if source == 2 else 0.3)
        arrival = 3 * i + rng.uniform(0, disorder)
        rows.append((arrival, (source, i, ts, ok, None if ok else ("x" * 1200 if i % 5 == 0 else f"e{i}"))))
    return [row for _, row in sorted(rows)]


@pytest.mark.parametrize("disorder", [0, 50])
def test_stream_health_equals_batch(spark, tmp_path, disorder):
    rows = fetch_log(400, random.Random(disorder), disorder)
    rows += [(4, 900, START + timedelta(days=1), True, None), (4, 901, START + timedelta(days=1), False, None)]
    rows += [(None, 902, START, True, None), (1, 903, None, True, None)]
    path, name = str(tmp_path / "runs"), f"health{disorder}"
    write_in_turn(spark, rows, RUN, path, 100)
    drained(spark, path, RUN, lambda s: stream_health(s, "1 hour", "10 days"), name, "update")
    # The latest line of a source: fewer failures follow a later success only.
    final = {}
    for r in spark.table(name).collect():
        final[r.source_id] = (r.last_fetched_at, r.error_count, r.last_error)
        assert r.late_successes == 0 and not r.silent
    whole = catalog.source_health(spark.createDataFrame(rows, RUN).where("source_id is not null and ts is not null"))
    assert final == {r.source_id: (r.last_fetched_at, r.error_count, r.last_error) for r in whole.collect()}
    assert final[4] == (START + timedelta(days=1), 1, None)


def test_kept_health_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = fetch_log(120, random.Random(8), 30)
    path, table, checkpoint = (str(tmp_path / name) for name in ("runs", "table", "checkpoint"))
    for part in (rows[:60], rows[60:]):
        write_in_turn(spark, part, RUN, path, 60)
        stream = spark.readStream.schema(RUN).parquet(path)
        follow_health(stream, table, checkpoint, "1 hour", "10 days").awaitTermination()
    key = lambda df: sorted((r.source_id, r.last_fetched_at, r.error_count, r.last_error) for r in df.collect())
    assert key(current_health(spark, table)) == key(catalog.source_health(spark.createDataFrame(rows, RUN)))


def test_silent_sources_and_late_successes(spark, tmp_path):
    def at(minutes):
        return START + timedelta(minutes=minutes)

    batches = [
        [(1, 1, at(0), False, "a"), (2, 2, at(0), True, None)],
        [(1, 3, at(200), False, "b")],
        [(1, 4, at(400), False, "c")],
        [(1, 5, at(100), True, None)],
        [(1, 6, at(410), False, "d")],
        [(1, 7, at(3000), True, None)],
        [(1, 8, at(3001), True, None)],
    ]
    path = str(tmp_path / "runs")
    for batch in batches:
        write_in_turn(spark, batch, RUN, path, 10)
    query = drained(spark, path, RUN, lambda s: stream_health(s, "1 hour", "1 day"), "silent", "update")
    lines = spark.table("silent").collect()
    one = [r for r in lines if r.source_id == 1]
    # The success of minute 100 is behind the watermark: it resets nothing.
    assert [r.error_count for r in one if not r.silent][-3:] == [4, 0, 0]
    assert late_rows(query) + one[-1].late_successes == 1
    two = [r for r in lines if r.source_id == 2]
    assert [r.silent for r in two] == [False, True] and two[-1].last_fetched_at == START


def test_stream_delays_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    published, delivered = [], []
    for i in range(120):
        when = START + timedelta(minutes=10 * i)
        published.append((i, "ab"[i % 3 == 0], when))
        for _ in range(rng.randrange(0, 3)):
            delivered.append((i, when + timedelta(seconds=rng.randrange(0, 200_000))))
    delivered.sort(key=lambda r: r[1])
    p_schema, d_schema = "article_id long, topic string, published_at timestamp", "article_id long, delivered_at timestamp"
    p_path, d_path = str(tmp_path / "p"), str(tmp_path / "d")
    write_in_turn(spark, [*published, (None, "a", START)], p_schema, p_path, 40)
    write_in_turn(spark, delivered, d_schema, d_path, 40)
    publications = spark.readStream.schema(p_schema).option("maxFilesPerTrigger", 1).parquet(p_path)

    def job(deliveries):
        return stream_delays(publications, deliveries, "3 days", "2 days")

    query = drained(spark, d_path, d_schema, job, "delays", "append")
    assert late_rows(query) == 0
    batch = spark.createDataFrame(published, p_schema).join(spark.createDataFrame(delivered, d_schema), "article_id")
    want = insights.time_to_delivery(batch, "topic")
    got = insights.time_to_delivery(spark.table("delays"), "topic")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.table("delays").count() == len(delivered)


def test_late_deliveries_are_counted(spark, tmp_path):
    p_schema, d_schema = "article_id long, published_at timestamp", "article_id long, delivered_at timestamp"
    p_path, d_path = str(tmp_path / "p"), str(tmp_path / "d")
    days = [START + timedelta(days=d) for d in range(6)]
    write_in_turn(spark, [(d, days[d]) for d in range(6)], p_schema, p_path, 1)
    in_time = [(d, days[d] + timedelta(hours=1)) for d in range(5)]
    write_in_turn(spark, [*in_time, (0, days[0] + timedelta(hours=2))], d_schema, d_path, 1)
    publications = spark.readStream.schema(p_schema).option("maxFilesPerTrigger", 1).parquet(p_path)
    query = drained(spark, d_path, d_schema, lambda s: stream_delays(publications, s, "1 day", "1 hour"), "late", "append")
    assert late_rows(query) == 1
    assert sorted(r.article_id for r in spark.table("late").collect()) == [0, 1, 2, 3, 4]


def test_periods_from_daily_sketches(spark):
    n = 60_000
    activity = spark.range(n).select(
        F.timestamp_add("MINUTE", F.col("id") % 40_000, F.lit(START)).alias("ts"),
        (F.col("id") * 7919 % 9000).alias("user_id"),
        F.lit("t").alias("topic"),
        (F.col("id") % 500).alias("article_id"),
        (F.col("id") % 3 == 0).alias("is_view"),
        (F.col("id") % 6 == 0).alias("is_interaction"),
    )
    for period in ("week", "month"):
        start = F.to_date(F.date_trunc(period, "ts"))
        exact = {
            r.p: r
            for r in activity.groupBy(start.alias("p"))
            .agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"), F.countDistinct("article_id").alias("a"))
            .collect()
        }
        rows = periods.usage_over(periods.daily_usage(activity), period).collect()
        assert len(rows) == len(exact)
        for r in rows:
            want = exact[r.period_start]
            assert r.events == want.n and abs(r.interaction_rate - 0.5) < 0.01
            assert abs(r.active_users - want.u) <= 0.03 * want.u
            assert abs(r.articles - want.a) <= 0.03 * want.a


def test_delays_over_periods(spark):
    delays = spark.range(50_000).select(
        (F.col("id") % 3).alias("topic"),
        F.timestamp_add("DAY", (F.col("id") % 28).cast("int"), F.lit(START)).alias("delivered_at"),
        (F.col("id") * 7919 % 100_000).alias("sec"),
    )
    delays = delays.withColumn("published_at", F.timestamp_add("SECOND", -F.col("sec"), "delivered_at")).drop("sec")
    delays = delays.unionByName(spark.createDataFrame([(0, START, None)], "topic long, delivered_at timestamp, published_at timestamp"))
    daily = periods.daily_delays(delays, "topic")
    month = {r.topic: r for r in periods.delays_over(daily, "month", "topic").collect()}
    hours = (F.unix_micros("delivered_at") - F.unix_micros("published_at")) / 3_600_000_000
    known = delays.withColumn("h", hours).where("h is not null")
    for topic, r in month.items():
        mine = known.where(F.col("topic") == topic)
        assert r.n == mine.count() and r.longest == mine.agg(F.max("h")).first()[0]
        for value, share in ((r.p50_hours, 0.5), (r.p95_hours, 0.95)):
            rank = mine.where(F.col("h") <= value).count() / r.n
            assert abs(rank - share) < 0.02
