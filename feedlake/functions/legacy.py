"""The legacy cleaning profile (used when normalisation is switched off)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions.text import delete_patterns, empty_to_null, strip_markup, strip_whitespace


def sanitize_html(text: Column) -> Column:
    """Plain text with entities, markup and active content deleted.

    Stray "&", "<" and ">" count as entities here: they are deleted too.
    """
    text = strip_markup(text, drop_scripts=False)
    text = delete_patterns(text, C.LEGACY_SCRIPT_PATTERNS, "isU")
    text = F.regexp_replace(text, C.LEGACY_ENTITY_PATTERN + "|[&<>]", "")
    text = F.regexp_replace(text, r"(?iU)on\w+\s*=", "")
    text = delete_patterns(text, C.LEGACY_SQL_PATTERNS, "iU")
    return strip_whitespace(F.substring(text, 1, C.SUMMARY_MAX_LEN))


def legacy_title(text: Column) -> Column:
    text = sanitize_html(F.coalesce(text, F.lit("")))
    for keyword in C.LEGACY_TITLE_KEYWORDS:
        text = F.replace(text, F.lit(keyword), F.lit(""))
        if keyword.lower() != keyword:
            text = F.replace(text, F.lit(keyword.lower()), F.lit(""))
    return F.coalesce(empty_to_null(text), F.lit(C.DEFAULT_TITLE))


def legacy_text(text: Column) -> Column:
    """Summary or author: sanitised, null when nothing is left."""
    return empty_to_null(sanitize_html(text))


def legacy_tags(tags: Column) -> Column:
    """Sanitised tags in their own order; neither sorted nor deduplicated."""
    cleaned = F.filter(F.transform(tags, sanitize_html), lambda t: t != "")
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def first_alternate_link(link: Column, links: Column) -> Column:
    """The link, else the address of the first alternate one, else null."""
    alternate = F.get(F.filter(links, lambda item: item["rel"] == "alternate"), F.lit(0))
    return F.coalesce(empty_to_null(link), empty_to_null(alternate["href"]))
