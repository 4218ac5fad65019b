"""Block lists of any length, and frozen IDF tables."""

from __future__ import annotations

import ipaddress
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from feedlake.operators import networks as net
from feedlake.operators import ranking
from feedlake.operators.idf import IdfStore


def plain(hosts, listed):
    known = {}
    for text in listed:
        try:
            known.setdefault(ipaddress.ip_network(text, strict=False), []).append(text)
        except ValueError:
            continue
    out = {}
    for host in hosts:
        try:
            address = ipaddress.ip_address(host)
        except ValueError:
            continue
        size = 32 if address.version == 4 else 128
        for bits in range(size, -1, -1):
            found = known.get(ipaddress.ip_network(f"{host}/{bits}", strict=False))
            if found:
                out[host] = min(found)
                break
    return out


def test_longest_prefix_of_a_long_list(spark):
    rng = random.Random(1)
    four = [str(ipaddress.IPv4Address(rng.randrange(2**32))) for _ in range(20_000)]
    six = [str(ipaddress.IPv6Address(rng.randrange(2**20) << 108 | rng.randrange(2**108))) for _ in range(5_000)]
    listed = [f"{a}/{rng.randrange(6, 33)}" for a in four] + [f"{a}/{rng.randrange(8, 129)}" for a in six]
    listed += ["10.0.0.0/8", "10.0.0.9/8", "10.1.2.3", "::1", "fe80::/10", "10.0.0.0/33", "no/8", "", "1.2.3/8", "::/129", "10.1.0.0/"]
    hosts = four[:300] + six[:300] + [str(ipaddress.IPv4Address(rng.randrange(2**32))) for _ in range(500)]
    hosts += ["10.1.2.3", "10.200.0.1", "::1", "::2", "fe80::1", "fec0::1", "example.com", "", "10.1.2", "10.200.0.1"]
    table = spark.createDataFrame([(x,) for x in [*listed, None]], "network string")
    frame = spark.createDataFrame([(x,) for x in [*hosts, None]], "host string")
    found = net.longest_network(frame, table)
    assert {r.host: r.network for r in found.collect()} == plain(hosts, listed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert net.longest_network(frame, table.where("false")).count() == 0


def articles(spark, days):
    rows = []
    for d in days:
        for k in range(6):
            rows.append((d * 10 + k, f"word{k % 3} day{d}", f"more word{k} of day{d}", datetime(2024, 1, 1) + timedelta(days=d, hours=k)))
    return spark.createDataFrame(rows, "article_id long, title string, body string, published_at timestamp")


def table(rows):
    return {r.term: round(r.idf, 9) for r in rows.collect()}


def at(day):
    return F.lit(datetime(2024, 1, 1) + timedelta(days=day))


def test_a_window_is_frozen_and_moves_by_days(spark, tmp_path):
    now = [1000.0]
    store = IdfStore(spark, str(tmp_path / "s"), lifetime=60, clock=lambda: now[0])
    rows = articles(spark, range(10))

    def fresh(first, last):
        part = rows.where((F.col("published_at") >= at(first)) & (F.col("published_at") < at(last)))
        return table(ranking.idf_snapshot(ranking.term_counts(part), part))

    counted = []
    count = store._count
    store._count = lambda window, names: (counted.append([n[:10] for n in names]), count(window, names))
    assert table(store.frozen(rows, at(0), at(7))) == fresh(0, 7)
    assert counted == [[f"2024-01-0{d}" for d in range(1, 8)]]
    # Within its lifetime a window is read; after it, summed again; a day on, one day is new.
    first = store.frozen(rows, at(0), at(7)).inputFiles()
    now[0] += 61
    second = store.frozen(rows, at(0), at(7))
    assert second.inputFiles() != first and table(second) == fresh(0, 7)
    assert table(store.frozen(rows, at(1), at(8))) == fresh(1, 8)
    assert counted[1:] == [["2024-01-08"]]
    # Another article makes another set of the day.
    rows = rows.unionByName(articles(spark, [3]).where("article_id = 30").withColumn("article_id", F.lit(99).cast("long")))
    assert table(store.frozen(rows, at(1), at(8))) == fresh(1, 8)
    assert counted[2:] == [["2024-01-04"]]
    assert store.frozen(rows, at(50), at(60)).count() == 0


def test_running_total_of_a_hot_key_in_a_sparse_order(spark):
    from feedlake.operators.summaries import running_total

    rows = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).when(F.col("id") % 10 > 1, 0).alias("day"),
        F.sha2(F.col("id").cast("string"), 256).alias("place"), (F.col("id") % 13).alias("n"),
    ).repartition(5)
    want, so_far = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.day or 0, r.place)):
        so_far[r.day] = so_far.get(r.day, 0) + r.n
        want[r.place] = so_far[r.day]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_total(rows, ["day"], "place", "n", "total")
        assert {r.place: r.total for r in got.collect()} == want
        assert got.columns == ["day", "place", "n", "total"]
        cut = rows.repartitionByRange("day", "place").where("day = 0").select(F.spark_partition_id())
        assert cut.distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
