"""Feed files: RSS and Atom items, feed metadata, damaged payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import config as C
from feedlake import schemas
from feedlake.functions.text import unescape
from feedlake.sources.decode import decode_payloads

_TEXT = T.StringType()
_CORRUPT = "_corrupt_record"


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(name, _TEXT) for name in names]


_PAYLOAD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

RSS_ITEM = T.StructType(
    [
        *_fields("title", "link", "description", "author", "dc:creator", "pubDate", "dc:date"),
        T.StructField("category", T.ArrayType(_TEXT)),
        *_fields(_CORRUPT),
    ]
)

ATOM_ENTRY = T.StructType(
    [
        *_fields("title", "summary", "content", "published", "updated"),
        T.StructField("author", T.StructType(_fields("name"))),
        T.StructField("link", T.ArrayType(T.StructType(_fields("_rel", "_href")))),
        T.StructField("category", T.ArrayType(T.StructType(_fields("_term")))),
        *_fields(_CORRUPT),
    ]
)

_ITEM_START = r"(?i)(?=<(?:item|entry)[\s>])"
_ITEM = r"(?is)^<(item|entry)[\s>].*?</\1\s*>"
#: Note on a payload that is not read for its size.
OVERSIZED = "payload above the size limit"


def _null(data_type: str) -> Column:
    return F.lit(None).cast(data_type)


def _links_type() -> T.DataType:
    return schemas.ENTRY["links"].dataType


def _parsed(xml: Column, schema: T.StructType) -> Column:
    """One element out of an XML string; damage shows in its corrupt-record field."""
    names = schema.simpleString()
    for name in ("dc:creator", "dc:date"):
        names = names.replace(name, f"`{name}`")
    return F.from_xml(xml, names, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})


def read_texts(
    spark: SparkSession, path: str, streaming: bool = False, limit: int = C.MAX_PAYLOAD_BYTES, **options: str
) -> DataFrame:
    """(feed_path, feed_time, length, size_ok, charset, rule, text, n_replaced) per file.

    No file can stop the scan: one above the size limit is not opened (its text is
    null), bytes are decoded by rule, and what no rule can decode becomes replacement
    characters, which are counted.
    """
    files = read_payloads(spark, path, streaming, **options)
    guarded = payload_size_guard(files, limit=limit)
    small = decode_payloads(guarded.filter(F.col("length") <= limit))
    names = ["feed_path", "feed_time", "length", "size_ok", "charset", "rule", "text", "n_replaced"]
    renamed = {"path": "feed_path", "modificationTime": "feed_time"}
    large = guarded.filter(F.col("length") > limit).drop("content").withColumns(
        {"charset": _null("string"), "rule": _null("string"), "text": _null("string"), "n_replaced": _null("int")}
    )
    return small.withColumnsRenamed(renamed).select(names).unionByName(
        large.withColumnsRenamed(renamed).select(names)
    )


def split_items(texts: DataFrame) -> DataFrame:
    """A row per item or entry, with its ordinal in the file and its markup; ``xml`` is
    null where the closing tag is missing. ``head`` is what stands ahead of the first
    item, on each file's first row; a file without items has that row alone, and its
    ordinal is null. (An item tag spelled out inside a CDATA section counts as a start.)
    """
    pieces = F.split(F.coalesce("text", F.lit("")), _ITEM_START)
    # A text that begins with an item has no head, but an empty piece is not split off.
    headless = F.coalesce("text", F.lit("")).rlike(r"(?i)^<(?:item|entry)[\s>]")
    rows = texts.withColumn("_pieces", F.when(headless, F.concat(F.array(F.lit("")), F.array_remove(pieces, ""))).otherwise(pieces))
    items = F.slice("_pieces", F.lit(2), F.greatest(F.size("_pieces") - 1, F.lit(0)))
    # The head goes with the first item, so no row carries the text or the pieces of its file.
    first = F.get("_pieces", F.lit(0))
    headed = F.transform(items, lambda x, i: F.struct(F.when(i == 0, first).alias("head"), x.alias("piece")))
    none = F.array(F.struct(first.alias("head"), _null("string").alias("piece")))
    rows = rows.select(*texts.columns, F.when(F.size(items) > 0, headed).otherwise(none).alias("_items"))
    rows = rows.select(*texts.columns, F.posexplode("_items").alias("at", "i"))
    return rows.select(
        *texts.columns,
        F.when(F.col("i.piece").isNotNull(), F.col("at")).alias("ordinal"),
        F.col("i.piece").alias("piece"),
        F.col("i.head").alias("head"),
    ).select(
        "*",
        F.nullif(F.regexp_extract("piece", _ITEM, 0), F.lit("")).alias("xml"),
        F.lower(F.regexp_extract("piece", r"(?i)^<(item|entry)", 1)).alias("tag"),
    )


def _entries(items: DataFrame) -> DataFrame:
    """Rows of split_items in the common entry shape."""
    parsed = items.withColumns(
        {
            "rss": _parsed(F.when(F.col("tag") == "item", F.col("xml")), RSS_ITEM),
            "atom": _parsed(F.when(F.col("tag") == "entry", F.col("xml")), ATOM_ENTRY),
        }
    )
    links = F.transform(
        "atom.link",
        lambda a: F.struct(
            F.coalesce(a["_rel"], F.lit("alternate")).alias("rel"), a["_href"].alias("href")
        ),
    )
    alternate = F.get(F.filter(links, lambda a: a["rel"] == "alternate"), F.lit(0))
    damage = (
        F.when(~F.col("size_ok"), F.lit(OVERSIZED))
        .when(F.col("ordinal").isNotNull() & F.col("xml").isNull(), F.col("piece"))
        .otherwise(F.coalesce(f"rss.{_CORRUPT}", f"atom.{_CORRUPT}"))
    )
    return parsed.select(
        "feed_path",
        "feed_time",
        "ordinal",
        F.coalesce("rss.title", "atom.title").alias("title"),
        F.coalesce("rss.link", alternate["href"]).alias("link"),
        links.cast(_links_type()).alias("links"),
        F.col("atom.summary").alias("summary"),
        F.coalesce("rss.description", "atom.content").alias("description"),
        F.coalesce("rss.author", "rss.`dc:creator`", "atom.author.name").alias("author"),
        F.coalesce(F.col("rss.category"), F.transform("atom.category", lambda c: c["_term"])).alias("tags"),
        F.coalesce("rss.pubDate", "atom.published").alias("published"),
        F.coalesce("rss.`dc:date`", "atom.updated").alias("updated"),
        damage.alias("corrupt_record"),
    )


def read_entries(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    dialects: tuple[str, ...] = ("rss", "atom"),
    limit: int = C.MAX_PAYLOAD_BYTES,
    **options: str,
) -> DataFrame:
    """Entries of all feed files below ``path``; a feed without items gives none.

    One scan reads both dialects. An entry that cannot be read (cut off, not well
    formed) and a file above the size limit are rows with ``corrupt_record``, which
    validation reports; every other entry of the same file is read.
    """
    wanted = [{"rss": "item", "atom": "entry"}[d] for d in dialects]
    items = split_items(read_texts(spark, path, streaming, limit, **options))
    return _entries(items.filter(F.col("tag").isin(wanted) | ~F.col("size_ok")))


def feed_order(entries: DataFrame) -> DataFrame:
    """Add ``feed_order``: file time, file and place in it, as text that sorts like them."""
    moment = F.lpad(F.unix_micros("feed_time").cast("string"), 20, "0")
    place = F.lpad(F.coalesce("ordinal", F.lit(0)).cast("string"), 9, "0")
    return entries.withColumn("feed_order", F.concat_ws("|", moment, "feed_path", place))


def read_payloads(spark: SparkSession, path: str, streaming: bool = False, **options: str) -> DataFrame:
    """Whole payloads as landed: path, modificationTime, length, content."""
    reader = spark.readStream.schema(_PAYLOAD) if streaming else spark.read
    return reader.format("binaryFile").options(**options).option("recursiveFileLookup", "true").load(path)


def payload_size_guard(
    payloads: DataFrame, length: str = "length", limit: int = C.MAX_PAYLOAD_BYTES
) -> DataFrame:
    """Mark payloads above the size limit; filter on ``size_ok`` before parsing."""
    return payloads.withColumn("size_ok", F.col(length) <= F.lit(limit))


def parse_items(payloads: DataFrame, xml: str) -> DataFrame:
    """Parse one item per row out of an XML string column.

    A damaged payload is no error: the row survives with ``parse_error`` set.
    """
    parsed = _parsed(F.col(xml), RSS_ITEM)
    return payloads.withColumn("item", parsed).withColumn(
        "parse_error", F.col(f"item.{_CORRUPT}").isNotNull()
    )


def _head_text(tag: str) -> Column:
    """Text of the first such element of a head, without CDATA marks and entities."""
    inner = F.regexp_extract("head", rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    return unescape(F.trim(F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")))


def feed_metadata(
    spark: SparkSession, path: str, limit: int = C.MAX_PAYLOAD_BYTES, feed: Column | None = None
) -> DataFrame:
    """Per feed: title, link, description, entry_count, parsing_errors.

    One scan. The channel's own fields are those ahead of its first item. A feed is a
    file, or all files for which ``feed``, an expression over feed_path, is the same:
    their entries are counted together, in as many tasks as there are files.
    """
    closed = F.col("text").rlike(r"(?i)</(?:channel|feed)\s*>")
    # A text is searched once, ahead of its items, whose rows go without it.
    texts = read_texts(spark, path, limit=limit).withColumn("damaged", F.coalesce(~closed, F.lit(True)))
    rows = split_items(texts).drop("text").withColumns(
        {
            "_title": _head_text("title"),
            "_link": _head_text("link"),
            "_about": F.coalesce(F.nullif(_head_text("description"), F.lit("")), _head_text("subtitle")),
            "rss": _parsed(F.when(F.col("tag") == "item", F.col("xml")), RSS_ITEM),
            "atom": _parsed(F.when(F.col("tag") == "entry", F.col("xml")), ATOM_ENTRY),
        }
    )
    good = F.col("xml").isNotNull() & F.coalesce(f"rss.{_CORRUPT}", f"atom.{_CORRUPT}").isNull()
    # One row of a file has its head; the others are null there.
    name = F.col("feed_path") if feed is None else feed
    per_feed = rows.groupBy(name.alias("feed_path")).agg(
        F.max("_title").alias("title"),
        F.max("_link").alias("link"),
        F.max("_about").alias("description"),
        F.bool_or("damaged").alias("damaged"),
        F.count_if(good).alias("entry_count"),
        F.count_if(F.col("ordinal").isNotNull() & ~good).alias("bad_entries"),
    )
    return summarize_feeds(per_feed)


def summarize_feeds(feeds: DataFrame) -> DataFrame:
    """Defaults and the list of parsing errors (one per kind, with its count)."""
    bad = F.coalesce("bad_entries", F.lit(0))
    return feeds.select(
        "feed_path",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(C.DEFAULT_FEED_TITLE)).alias("title"),
        F.coalesce("link", F.lit("")).alias("link"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("entry_count", F.lit(0)).cast("long").alias("entry_count"),
        F.array_compact(
            F.array(
                F.when(F.coalesce("damaged", F.lit(False)), F.lit("damaged channel")),
                F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" damaged entries"))),
            )
        ).alias("parsing_errors"),
    )


def _xml_bytes(value: Column) -> Column:
    """Bytes of a text in XML, at most: a character that is escaped takes up to six."""
    plain = F.translate(value, "<>&\"'", "")
    return F.coalesce(F.octet_length(value) + 5 * (F.length(value) - F.length(plain)), F.lit(0))


def _numbered_files(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """Add ``file``: each task's rows in order, a new number before ``most`` is exceeded."""
    sized = rows.withColumn("_size", size.cast("long"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = held = 0
        for batch in batches:
            files = []
            for n in batch.column("_size").to_pylist():
                if held and held + n > most:
                    file, held = file + 1, 0
                held += n
                files.append(file)
            columns = batch.drop_columns(["_size"])
            yield columns.append_column("file", pa.array(files, pa.int32()))

    schema = T.StructType([*rows.schema.fields, T.StructField("file", T.IntegerType())])
    return sized.mapInArrow(number, schema)


def write_rss(entries: DataFrame, path: str, most: int = C.MAX_PAYLOAD_BYTES // 2) -> None:
    """Write entries as RSS files (title, link, description, author, ...) of at most
    ``most`` bytes: a file is read by one task and has a size limit. Only an entry that
    is longer by itself makes a longer file. Files lie in numbered folders."""
    rows = entries.select("title", "link", "description", "author", "pubDate", "category")
    texts = ("title", "link", "description", "author", "pubDate")
    tags = F.coalesce(_xml_bytes(F.array_join("category", "")) + 40 * F.size("category"), F.lit(0))
    size = sum((_xml_bytes(F.col(c).cast("string")) for c in texts), tags) + 300
    (
        _numbered_files(rows, size, most)
        .write.partitionBy("file")
        .format("xml")
        .option("rowTag", "item")
        .option("rootTag", "channel")
        .option("declaration", 'version="1.0" encoding="UTF-8"')
        .mode("overwrite")
        .save(path)
    )
