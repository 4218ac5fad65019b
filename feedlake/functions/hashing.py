"""Content hashes: the identity of an article."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions.dates import iso_utc


def link_stamp(link: Column) -> Column:
    """Stands in for the time of an undated article."""
    return F.concat(F.lit("fallback:"), F.substring(F.sha2(link, 256), 1, 8))


def _sha(*parts: Column) -> Column:
    """Never null, so joins on it need no null filter (which would hash twice)."""
    return F.coalesce(F.sha2(F.concat_ws("|", *parts), 256), F.lit(""))


def content_hash(title: Column, link: Column, published_at: Column, summary: Column) -> Column:
    """SHA-256 over lower-cased title, link, time and the summary's start.

    The arguments are normalised fields; ``published_at`` is null for an undated
    article.
    """
    return _sha(
        F.lower(title),
        F.coalesce(link, F.lit("")),
        F.coalesce(iso_utc(published_at), link_stamp(F.coalesce(link, F.lit("")))),
        F.coalesce(F.substring(summary, 1, C.HASH_SUMMARY_PREFIX_LEN), F.lit("")),
    )


def legacy_content_hash(title: Column, link: Column, published_at: Column) -> Column:
    """Legacy identity: no summary in it."""
    return _sha(F.lower(title), link, F.coalesce(iso_utc(published_at), link_stamp(link)))


def source_key(feed_url: Column) -> Column:
    """Stable surrogate id of a source (positive)."""
    return F.abs(F.xxhash64(feed_url) % F.lit(2**62)) + F.lit(1)
