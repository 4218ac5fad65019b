"""Feed entries to article records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions import dates, hashing, legacy, text, urls

PROFILES = ("strict", "compat", "legacy")


def _first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[text.empty_to_null(c) for c in columns])


def field_fallbacks(entries: DataFrame) -> DataFrame:
    """Raw fields after fallbacks: summary or description, published or updated."""
    return entries.withColumns(
        {
            "raw_title": F.coalesce(F.col("title"), F.lit("")),
            "raw_summary": _first_filled(F.col("summary"), F.col("description")),
            "raw_author": F.col("author"),
            "raw_tags": F.filter(F.col("tags"), lambda t: t.isNotNull() & (t != "")),
            "raw_published": _first_filled(F.col("published"), F.col("updated")),
        }
    )


def _with_dates(raw: DataFrame, run_date: Column) -> DataFrame:
    """published_at and its fallback flag; the flag column is parsed only once."""
    return raw.withColumn("parsed_at", dates.parse_published(F.col("raw_published"))).withColumns(
        {
            "published_at": F.coalesce("parsed_at", F.date_trunc("day", run_date)),
            "is_fallback_date": F.col("parsed_at").isNull(),
        }
    )


def _strict(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "title": text.normalize_title(F.col("raw_title")),
            "link": urls.canonicalize_url(F.col("link")),
            "summary": text.normalize_summary(F.col("raw_summary")),
            "author": text.normalize_author(F.col("raw_author")),
            "tags": text.normalize_tags(F.col("raw_tags")),
        }
    )


def _compat_fields(df: DataFrame, title: str, summary: str, author: str | None) -> DataFrame:
    """Older step order; each stage is its own projection so that no regular
    expression chain is evaluated twice."""
    fields = [title, summary] + ([author] if author else [])

    def stage(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
        return rows.withColumns({name: text.settled(value) for name, value in columns.items()})

    df = stage(df, {c: text.nfkc(F.col(c)) for c in fields})
    first = {c: text.strip_markup(F.col(c), drop_scripts=False) for c in fields}
    # A stray "&" is spelt out before the patterns run, as a serialiser would.
    first[summary] = text.delete_active_content(
        F.regexp_replace(first[summary], r"&(?!#?\w+;)", "&amp;"), anchor=False
    )
    df = stage(df, first)
    df = stage(df, {c: text.unescape(F.col(c)) for c in fields})
    last = {
        title: text.title_tail(F.col(title)),
        summary: text.summary_tail(F.col(summary)),
    }
    if author:
        last[author] = text.empty_to_null(text.strip_whitespace(F.col(author)))
    return stage(df, last)


def _compat(raw: DataFrame) -> DataFrame:
    df = raw.withColumns(
        {
            "title": F.col("raw_title"),
            "summary": F.col("raw_summary"),
            "author": F.col("raw_author"),
            "link": urls.canonicalize_url(F.col("link")),
            "tags": text.normalize_tags(F.col("raw_tags"), drop_scripts=False),
        }
    )
    return _compat_fields(df, "title", "summary", "author")


def _legacy(raw: DataFrame) -> DataFrame:
    return raw.withColumn(
        "chosen_link", legacy.first_alternate_link(F.col("link"), F.col("links"))
    ).withColumns(
        {
            "title": legacy.legacy_title(F.col("raw_title")),
            "link": urls.canonicalize_url_legacy(F.col("chosen_link")),
            "summary": legacy.legacy_text(F.col("raw_summary")),
            "author": legacy.legacy_text(F.col("raw_author")),
            "tags": legacy.legacy_tags(F.col("raw_tags")),
        }
    )


def normalize_entries(entries: DataFrame, run_date: Column, profile: str = "strict") -> DataFrame:
    """Clean every field of every entry; other columns pass through.

    ``run_date`` stands in for missing dates (``is_fallback_date`` tells).
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    raw = _with_dates(field_fallbacks(entries), run_date)
    cleaned = {"strict": _strict, "compat": _compat, "legacy": _legacy}[profile](raw)
    dropped = ["raw_title", "raw_summary", "raw_author", "raw_tags", "raw_published",
               "description", "updated", "published", "links", "chosen_link"]
    return cleaned.drop(*dropped)


def _compat_hash(rows: DataFrame) -> DataFrame:
    """Clean title, link and summary a second time and hash the result."""
    again = rows.withColumns(
        {
            "hash_title": F.lower("title"),
            "hash_link": urls.canonicalize_url(F.col("link")),
            "hash_summary": F.col("summary"),
        }
    )
    again = _compat_fields(again, "hash_title", "hash_summary", None)
    return again.withColumn(
        "content_hash",
        hashing.content_hash(
            F.col("hash_title"), F.col("hash_link"), F.col("published_at"), F.col("hash_summary")
        ),
    ).drop("hash_title", "hash_link", "hash_summary")


def map_articles(entries: DataFrame, run_date: Column, profile: str = "strict") -> DataFrame:
    """Entries to article records with their content hash.

    In the strict profile an undated entry is hashed without its stand-in date,
    so that loading it again tomorrow finds it. Columns that are no entry fields
    (``source_id``, ``feed_order``, ...) pass through.
    """
    rows = normalize_entries(entries, run_date, profile)
    if profile == "compat":
        rows = _compat_hash(rows)
    elif profile == "legacy":
        rows = rows.withColumn(
            "content_hash",
            hashing.legacy_content_hash(F.col("title"), F.col("link"), F.col("parsed_at")),
        )
    else:
        rows = rows.withColumn(
            "content_hash",
            hashing.content_hash(
                F.col("title"), F.col("link"), F.col("parsed_at"), F.col("summary")
            ),
        )
    return rows.drop("parsed_at").withColumnRenamed("summary", "summary_raw")


def suspicious_summaries(articles: DataFrame) -> DataFrame:
    """Articles whose cleaned summary still names active content."""
    flagged = articles.withColumns(
        {
            "suspicious": text.settled(text.is_suspicious(F.col("summary_raw"))),
            "summary_preview": F.substring("summary_raw", 1, C.PREVIEW_LEN),
        }
    )
    return flagged.filter("suspicious").drop("suspicious")
