"""Feed files, decoding, loads and streams end to end."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedlake import schemas
from feedlake.operators.dedup import first_wins
from feedlake.operators.entries import map_articles
from feedlake.operators.insights import freshness
from feedlake.session import materialize, shared_dir, spread
from feedlake.sinks import tables as sink
from feedlake.sources import decode, feeds, tables
from feedlake.streaming.freshness import stream_freshness
from feedlake.streaming.ingest import dedup_within, stream_ingest

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0"><channel><title>News</title><link>https://e.com</link>
<description>All of it</description>{items}</channel></rss>"""

ITEM = """<item><title>Story {i} &amp; more</title><link>https://e.com/{i}?utm_source=rss</link>
<description><![CDATA[<p>Text <b>{i}</b></p>]]></description><author>Ann</author>
<category>AI</category><category>ai</category>
<pubDate>Mon, 15 Jan 2023 10:00:00 GMT</pubDate></item>"""

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Blog</title>
<entry><title>Post</title><link rel="self" href="https://b.com/self"/>
<link rel="alternate" href="https://b.com/post"/><summary>Sum</summary>
<updated>2023-01-15T10:00:00Z</updated><author><name>Bob</name></author>
<category term="X"/><category term="Y"/></entry></feed>"""


def items(*numbers):
    return RSS.format(items="".join(ITEM.format(i=i) for i in numbers))


def run_date():
    return F.lit("2023-02-01").cast("timestamp")


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    return folder


def test_rss_and_atom_entries(spark, landing):
    (landing / "a.xml").write_text(items(1, 2))
    (landing / "b.xml").write_text(ATOM)
    (landing / "empty.xml").write_text(RSS.format(items=""))
    rows = {r.title: r for r in feeds.read_entries(spark, str(landing)).collect()}
    assert set(rows) == {"Story 1 & more", "Story 2 & more", "Post"}
    story, post = rows["Story 1 & more"], rows["Post"]
    assert story.description.strip() == "<p>Text <b>1</b></p>"
    assert story.tags == ["AI", "ai"] and story.feed_path.endswith("a.xml")
    assert (post.link, post.author, post.tags) == ("https://b.com/post", "Bob", ["X", "Y"])
    assert [x.rel for x in post.links] == ["self", "alternate"]
    columns = feeds.read_entries(spark, str(landing)).columns
    assert columns == schemas.ENTRY.fieldNames()


def test_malformed_feed_is_no_crash(spark, landing):
    (landing / "bad.xml").write_text("<rss><channel><item><title>x</title><link>y</channel></rss>")
    (landing / "good.xml").write_text(items(1))
    rows = feeds.read_entries(spark, str(landing)).collect()
    assert sum(r.corrupt_record is None for r in rows) == 1
    meta = {r.feed_path.rsplit("/", 1)[1]: r for r in feeds.feed_metadata(spark, str(landing)).collect()}
    assert (meta["good.xml"].title, meta["good.xml"].entry_count) == ("News", 1)
    assert meta["good.xml"].parsing_errors == []
    assert meta["bad.xml"].title == "Unknown Feed" and meta["bad.xml"].entry_count == 0


def bad_folder(folder):
    """Good, undeclared Latin-1, stray-byte, cut-off, oversized and foreign files."""
    (folder / "good.xml").write_text(items(1, 2))
    (folder / "latin.xml").write_bytes(items(3).replace("UTF-8", "none").replace(' encoding="none"', "").replace("more", "caf\xe9").encode("latin-1"))
    (folder / "stray.xml").write_bytes(items(4).encode() + b"\xff\xfe\x80")
    (folder / "cut.xml").write_text(items(5, 6)[:-150])
    (folder / "large.xml").write_text(items(*range(100, 160)))
    (folder / "page.xml").write_text("<html><body>moved</body></html>")
    (folder / "empty.xml").write_text("")


def test_no_file_stops_a_scan(spark, landing, tmp_path):
    bad_folder(landing)
    rows = feeds.read_entries(spark, str(landing), limit=8000).collect()
    named = {r.title: r for r in rows if r.corrupt_record is None}
    assert set(named) == {"Story 1 & more", "Story 2 & more", "Story 3 & caf\xe9", "Story 4 & more", "Story 5 & more"}
    damaged = {r.feed_path.rsplit("/", 1)[1]: r.corrupt_record for r in rows if r.corrupt_record is not None}
    assert set(damaged) == {"cut.xml", "large.xml"}
    assert damaged["large.xml"] == feeds.OVERSIZED and damaged["cut.xml"].startswith("<item><title>Story 6")
    texts = {r.feed_path.rsplit("/", 1)[1]: r for r in feeds.read_texts(spark, str(landing), limit=8000).collect()}
    assert texts["large.xml"].text is None and not texts["large.xml"].size_ok
    assert texts["latin.xml"].charset == "iso-8859-1"
    meta = {r.feed_path.rsplit("/", 1)[1]: r for r in feeds.feed_metadata(spark, str(landing), limit=8000).collect()}
    assert (meta["cut.xml"].entry_count, meta["cut.xml"].parsing_errors) == (1, ["damaged channel", "1 damaged entries"])
    assert meta["page.xml"].parsing_errors == ["damaged channel"]


def test_stream_counts_what_it_cannot_read(spark, landing, tmp_path):
    bad_folder(landing)
    table = str(tmp_path / "table")
    query = stream_ingest(spark, str(landing), table, str(tmp_path / "cp"), F.lit(1).cast("long"), run_date())
    query.awaitTermination()
    total = spark.read.parquet(f"{table}/counters").agg(F.sum("parsed"), F.sum("inserted"), F.sum("errors")).first()
    assert tuple(total) == (66, 65, 1)
    kept = spark.read.parquet(f"{table}/quarantine").collect()
    assert [r.violations[0] for r in kept] == ["corrupt_record"]


def test_first_entry_wins_whatever_the_partitions(spark, landing, tmp_path):
    import os

    same = '<item><title>Same</title><link>https://e.com/x</link><description>text</description><author>{a}</author></item>'
    (landing / "b.xml").write_text(RSS.format(items=same.format(a="one") + same.format(a="two") + items(1)[:0]))
    (landing / "a.xml").write_text(RSS.format(items=same.format(a="three")))
    os.utime(landing / "b.xml", (1, 1))
    for k in range(3):
        entries = feeds.feed_order(feeds.read_entries(spark, str(landing))).withColumn("source_id", F.lit(1).cast("long"))
        rows = map_articles(entries.repartition(k + 1, F.rand(k)), run_date())
        loaded = sink.load_articles(rows, str(tmp_path / f"t{k}"), "001", ["feed_order"])
        assert counters(loaded) == {1: (3, 1, 2, 0)}
        assert [r.author for r in spark.read.parquet(str(tmp_path / f"t{k}/articles")).collect()] == ["one"]


def test_payload_parse_and_size_guard(spark, landing):
    (landing / "a.xml").write_text(items(1))
    payloads = feeds.payload_size_guard(feeds.read_payloads(spark, str(landing)), limit=10)
    assert not payloads.first().size_ok
    frame = spark.createDataFrame([(ITEM.format(i=5),), ("<item><title>cut",)], "x string")
    parsed = feeds.parse_items(frame, "x").collect()
    assert parsed[0]["item"].title == "Story 5 & more" and not parsed[0].parse_error
    assert parsed[1].parse_error


def test_source_list(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"name": "n", "url": "u", "feed_url": "f", "credibility_score": 0.8}, {"name": "m"}]))
    rows = tables.read_source_list(spark, str(good)).collect()
    assert [(r.name, r.credibility_score, r.is_active) for r in rows] == [("n", 0.8, None), ("m", None, None)]
    bad.write_text('[{"name": "n", ')
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        tables.read_source_list(spark, str(bad)).collect()


def test_decoding_by_rule(spark):
    declared = b'<?xml version="1.0" encoding="%s"?><t>'
    payloads = {
        "ascii": b"plain",
        "utf8": "é".encode(),
        "mark": "﻿é".encode(),
        "utf16": "héé".encode("utf-16"),
        "latin": "é".encode("latin-1"),
        "latin_declared": declared % b"ISO-8859-1" + "é".encode("latin-1"),
        "cp1252": "“é”".encode("cp1252"),
        "cp1252_declared": declared % b"windows-1252" + "é€".encode("cp1252"),
        "forbidden": declared % b"koi8-r" + b"\xc1\xc2",
    }
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in payloads.items()], "k string, content binary")
    got = {r.k: (r.charset, r.text, r.n_replaced) for r in decode.decode_payloads(frame).collect()}
    assert got["ascii"] == ("ascii", "plain", 0)
    assert got["utf8"] == ("utf-8", "é", 0)
    assert got["mark"] == ("utf-8", "é", 0)
    assert got["utf16"] == ("utf-16", "héé", 0)
    assert got["latin"] == ("iso-8859-1", "é", 0)
    assert got["latin_declared"][0] == "iso-8859-1" and got["latin_declared"][1].endswith("é")
    assert got["cp1252"] == ("windows-1252", "“é”", 0)
    assert got["cp1252_declared"][0] == "windows-1252" and got["cp1252_declared"][1].endswith("é€")
    assert got["forbidden"][0] == "utf-8" and got["forbidden"][2] > 0
    names = spark.createDataFrame([("UTF-8",), ("utf-7",)], "c string")
    allowed = names.select(decode.is_encoding_allowed(F.col("c"))).collect()
    assert [r[0] for r in allowed] == [True, False]


def batch(spark, rows):
    frame = spark.createDataFrame(
        [(i, 1, f"T{n}", f"https://e.com/{n}", "" if n == "bad" else "2023-01-15") for i, n in rows],
        "feed_order long, source_id long, title string, link string, published string",
    )
    blank = {c: F.lit(None).cast("string") for c in ("summary", "description", "author", "updated")}
    frame = frame.withColumns(blank).withColumn("tags", F.array().cast("array<string>"))
    broken = F.when(F.col("published") == "", 0).otherwise(F.col("source_id")).cast("long")
    frame = frame.withColumn("source_id", broken)
    return map_articles(frame.withColumn("links", F.lit(None)), run_date())


def counters(df):
    return {r.source_id: (r.parsed, r.inserted, r.skipped, r.errors) for r in df.collect()}


def test_load_is_idempotent(spark, tmp_path):
    table = str(tmp_path / "articles")
    first = batch(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "bad")])
    order = ["feed_order"]
    assert counters(sink.load_articles(first, table, "001", order)) == {1: (3, 2, 1, 0), 0: (1, 0, 0, 1)}
    assert counters(sink.load_articles(first, table, "002", order)) == {1: (3, 0, 3, 0), 0: (1, 0, 0, 1)}
    more = batch(spark, [(1, "b"), (2, "c")])
    assert counters(sink.load_articles(more, table, "003", order)) == {1: (2, 1, 1, 0)}
    # A run that is executed again replaces its own output only.
    assert counters(sink.load_articles(more, table, "003", order)) == {1: (2, 1, 1, 0)}
    stored = spark.read.parquet(f"{table}/articles")
    assert sorted(r.title for r in stored.collect()) == ["Ta", "Tb", "Tc"]
    assert spark.read.parquet(f"{table}/quarantine").filter("run = '001'").first().violations == ["source_id"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "sources")
    with pytest.raises(FileNotFoundError):
        sink.read_snapshot(spark, path)
    assert sink.write_snapshot(spark.range(3), path) == 0
    grown = sink.read_snapshot(spark, path).selectExpr("id + 10 AS id")
    assert sink.write_snapshot(grown, path) == 1
    assert sorted(r.id for r in sink.read_snapshot(spark, path).collect()) == [10, 11, 12]


def test_large_feed(spark, landing, tmp_path):
    (landing / "large.xml").write_text(items(*range(100)))
    entries = feeds.feed_order(feeds.read_entries(spark, str(landing)))
    rows = map_articles(entries.withColumn("source_id", F.lit(7).cast("long")), run_date())
    result = sink.load_articles(rows, str(tmp_path / "t"), "001", ["feed_order"])
    assert counters(result) == {7: (100, 100, 0, 0)}


def test_stream_equals_batch(spark, landing, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")

    def drain():
        query = stream_ingest(
            spark, str(landing), table, checkpoint, F.lit(1).cast("long"), run_date(),
            files_per_trigger=1,
        )
        query.awaitTermination()
        return sorted(r.link for r in spark.read.parquet(f"{table}/articles").collect())

    (landing / "a.xml").write_text(items(1, 2))
    (landing / "b.xml").write_text(items(2, 3))
    assert drain() == ["https://e.com/1", "https://e.com/2", "https://e.com/3"]
    assert drain() == ["https://e.com/1", "https://e.com/2", "https://e.com/3"]
    (landing / "c.xml").write_text(items(3, 4))
    (landing / "d.xml").write_text(ATOM)
    streamed = drain()
    entries = feeds.read_entries(spark, str(landing)).withColumn("source_id", F.lit(1).cast("long"))
    loaded = first_wins(map_articles(entries, run_date()), "content_hash", ["link"])
    assert streamed == sorted(r.link for r in loaded.collect()) and len(streamed) == 5


def test_stream_freshness_equals_batch(spark, tmp_path):
    rows = [(datetime(2023, 1, 1, 0, m), float(m % 9)) for m in range(0, 60, 2)]
    frame = spark.createDataFrame(rows, "ts timestamp, lag_minutes double")
    path = str(tmp_path / "arrivals")
    frame.write.parquet(path)
    stream = spark.readStream.schema(frame.schema).parquet(path)
    query = (
        stream_freshness(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("fresh")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    key = lambda df: sorted((r.window_start, r.n, r.n_fresh, r.max_lag) for r in df.collect())
    assert key(spark.table("fresh")) == key(freshness(frame))


def test_bounded_stream_dedup(spark, tmp_path):
    rows = [(datetime(2023, 1, 1), "h1"), (datetime(2023, 1, 1, 1), "h1"), (datetime(2023, 1, 1), "h2")]
    frame = spark.createDataFrame(rows, "published_at timestamp, content_hash string")
    path = str(tmp_path / "rows")
    frame.write.parquet(path)
    stream = dedup_within(spark.readStream.schema(frame.schema).parquet(path))
    query = (
        stream.writeStream.outputMode("append").format("memory").queryName("kept")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.content_hash for r in spark.table("kept").collect()) == ["h1", "h2"]


def test_session_helpers(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialize(spark.range(4), "four").count() == 4
    assert spread(spark.range(10, numPartitions=1), "id").rdd.getNumPartitions() == 8
    wide = spark.range(10, numPartitions=8)
    assert spread(wide, "id") is wide


def test_declared_tables(spark, tmp_path):
    topics = spark.createDataFrame(
        [(1, 2, "n", ["k"], True, datetime(2023, 1, 1), datetime(2023, 1, 1))], schemas.TOPICS
    )
    topics.write.parquet(str(tmp_path / "topics"))
    assert tables.read_table(spark, str(tmp_path), "topics").first().keywords == ["k"]
    assert len(schemas.FOREIGN_KEYS) == 7 and len(schemas.UNIQUE_KEYS) == 8
