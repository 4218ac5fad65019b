"""The hash index of the article table, feed files by size, neighbouring topics."""

from __future__ import annotations

import glob
import hashlib
import os

from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.operators import insights
from feedlake.sinks import index as ix
from feedlake.sinks import tables as sink
from feedlake.sources import feeds


def hashes(numbers):
    return [hashlib.sha256(str(n).encode()).hexdigest() for n in numbers]


def frame(spark, numbers):
    return spark.createDataFrame([(h,) for h in hashes(numbers)], "content_hash string")


def write(spark, table, run, numbers):
    sink.write_run(frame(spark, numbers).withColumn("title", F.lit("t")), f"{table}/articles", run)


def stored(index, spark, numbers, before):
    return sorted(r[0] for r in index.stored(frame(spark, numbers), before).collect())


def test_lookup_before_and_after_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "PARTITION_ROWS", 20)
    table = str(tmp_path / "t")
    index = sink.article_index(spark, table)
    assert stored(index, spark, [1], "000") == []
    write(spark, table, "001", range(600))
    write(spark, table, "002", range(600, 1200))
    # Runs that never came to the index are found and added.
    assert index.repair("003") == ["001", "002"] and index.repair("003") == []
    asked = [5, 700, 5000]
    assert stored(index, spark, asked, "003") == sorted(hashes([5, 700]))
    assert stored(index, spark, asked, "002") == hashes([5])
    assert index.compact() == 0
    assert stored(index, spark, asked, "003") == sorted(hashes([5, 700]))
    # A run that is done again does not meet its own hashes.
    assert stored(index, spark, asked, "002") == hashes([5])
    write(spark, table, "003", [5000, *range(2000, 2050)])
    index.add("003")
    assert stored(index, spark, asked, "004") == sorted(hashes(asked))
    assert index.compact() == 1
    assert stored(index, spark, asked, "004") == sorted(hashes(asked))
    assert stored(index, spark, asked, "003") == sorted(hashes([5, 700]))


def test_a_load_opens_a_bounded_part_of_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "PARTITION_ROWS", 20)
    table = str(tmp_path / "t")
    index = sink.article_index(spark, table)
    write(spark, table, "001", range(3000))
    index.compact()
    files = glob.glob(f"{table}/index/base/snapshot=0/prefix=*/*.parquet")
    assert len(files) > 200
    found = index.candidates(frame(spark, [1, 2, 3]), "002")
    opened = [r[0] for r in found.select(F.input_file_name()).distinct().collect()]
    assert len([f for f in opened if "/base/" in f]) == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan
    assert "articles" not in "".join(opened)
    # A batch without a hash touches nothing.
    none = spark.createDataFrame([(None,)], "content_hash string")
    assert index.stored(none, "002").count() == 0


def test_items_are_landed_by_bytes(spark, tmp_path):
    path = str(tmp_path / "landing")
    rows = spark.range(300).select(
        F.concat(F.lit("t"), "id").alias("title"), F.concat(F.lit("https://e.org/?a=1&b="), "id").alias("link"),
        F.repeat(F.lit("<p>a & b</p>"), F.when(F.col("id") % 50 == 0, 9000).otherwise(400).cast("int")).alias("description"),
        F.lit("d").alias("author"), F.lit(None).cast("string").alias("pubDate"), F.array(F.lit("x"), F.lit("y")).alias("category"),
    ).coalesce(2)
    limit = 300_000
    feeds.write_rss(rows, path, most=limit // 2)
    sizes = [os.path.getsize(f) for f in glob.glob(f"{path}/*/*.xml")]
    assert len(sizes) > 10 and max(sizes) <= limit
    read = feeds.read_entries(spark, path, limit=limit)
    assert read.where("corrupt_record is null").select("link").distinct().count() == 300


def test_metadata_of_a_feed_in_several_files(spark, tmp_path):
    for k, items in enumerate((["<item><title>a</title></item>"] * 3, ["<item><title>b</title></item>", "<item><title>c</ti"])):
        folder = tmp_path / "feeds" / "h1" / str(k)
        folder.mkdir(parents=True)
        (folder / "f.xml").write_text(f"<rss><channel><title>T</title><link>l</link>{''.join(items)}</channel></rss>")
    feed = F.regexp_extract("feed_path", r"/(h\d+)/", 1)
    (row,) = feeds.feed_metadata(spark, str(tmp_path / "feeds"), feed=feed).collect()
    assert (row.feed_path, row.title, row.entry_count, row.parsing_errors) == ("h1", "T", 4, ["1 damaged entries"])


def test_neighbours_by_terms_or_by_users(spark):
    likes = [(u, t) for u in range(4) for t in ("a", "b")] + [(9, "a"), (9, "c"), (None, "a"), (1, None)] * 2
    terms = [("x", w) for w in ("rain", "wind", "sun", "all")] + [("y", w) for w in ("rain", "wind", "snow", "all")]
    terms += [("z", "all"), ("z", "rain"), ("a", "all"), ("b", "all"), (None, "rain"), ("z", None)] * 2
    found = insights.neighbouring_topics(
        spark.createDataFrame(likes, "user_id int, topic string"), spark.createDataFrame(terms, "topic string, term string")
    )
    got = {(r.topic, r.neighbour): (r.shared_users, r.shared_terms, r["rank"]) for r in found.collect()}
    # One user is too little for a and c; "all" counts for nobody; x and y share no user.
    assert got == {("a", "b"): (4, 0, 1), ("b", "a"): (4, 0, 1), ("x", "y"): (0, 2, 1), ("y", "x"): (0, 2, 1)}
    one = insights.neighbouring_topics(
        spark.createDataFrame([(u, t) for u in range(3) for t in "abcdef"], "user_id int, topic string"),
        spark.createDataFrame([], "topic string, term string"), C.AdjacencySettings(k=2),
    )
    assert sorted((r.topic, r.neighbour) for r in one.collect() if r.topic == "c") == [("c", "a"), ("c", "b")]
