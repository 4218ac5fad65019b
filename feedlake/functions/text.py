"""Text cleaning as Column expressions.

Two profiles exist. ``strict`` (the default) decodes entities first and then
strips markup, so nothing that was hidden behind an entity survives.
``compat`` keeps the older order (strip, delete patterns, decode), for hashes
that must equal ones computed before.

Unicode normalisation and full entity decoding are the only steps Spark has no
function for. Both run as Arrow UDFs that receive null for every value the JVM
can prove unchanged, so plain text never leaves the JVM.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import config as C

# Java tests the non-Latin members of a character class before its Latin-1 bit
# set, which makes mixed classes slow on ordinary text; hence the split classes.
_WS_RUN = f"[ {C.WHITESPACE_LATIN1}]{{2,}}|[{C.WHITESPACE_LATIN1}]"
_WS_OTHER = f"[{C.WHITESPACE_OTHER}]"

# The inside of a tag; a quoted attribute value may hold ">". Possessive
# throughout, so the matcher neither backtracks nor recurses.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
_BLOCK_START = rf"(?i)<(?:{'|'.join(C.BLOCK_ELEMENTS)})(?:[\s/]{_ATTRIBUTES})?>"
_MARKUP = rf"(?s)<!--.*?(?:-->|$)|<[!?][^>]*+>|</?[A-Za-z]{_ATTRIBUTES}>"
_SCRIPT_BODIES = (
    r"(?is)<script\b[^>]*+>.*?</script\s*+>|<style\b[^>]*+>.*?</style\s*+>"
)

# What every deletion pattern needs somewhere; text without it skips them all.
# Scanning for the word's last character and looking back beats trying each word
# at each position.
_HAZARD_MARKS = ("(", ":", "=", "<", "--")
_HAZARD_WORDS = (
    r"[.\s](?<=(?iU:document\.|window\.|location\.|DELETE\s|INSERT\s|UPDATE\s|DROP\s))"
)

_COMMON_NAMES = "|".join(entity[1:-1] for entity, _ in C.COMMON_ENTITIES)
_OTHER_ENTITY = rf"&(?!(?:{_COMMON_NAMES});)(?:#[0-9xX]|[^\t\n\f <&#;])"


def _nfkc_unstable_patterns() -> tuple[str, str]:
    """A quick (Latin-1 only) and a full pattern for text NFKC might change.

    They match a character unless NFKC neither changes it nor joins it to a
    neighbour.

    Derived from the Unicode data of the standard library. Short ranges are left
    out, which only sends a few more values to the Arrow path.
    """
    ranges: list[tuple[int, int]] = []
    start = None
    for point in range(0x10000):
        char = chr(point)
        stable = (
            not 0x1100 <= point <= 0x11FF
            and not 0xD800 <= point <= 0xDFFF
            and unicodedata.category(char)[0] != "M"
            and unicodedata.category(char) != "Cn"
            and unicodedata.is_normalized("NFKC", char)
        )
        if stable and start is None:
            start = point
        elif not stable and start is not None:
            ranges.append((start, point - 1))
            start = None
    kept = [(a, b) for a, b in ranges if b - a >= 40 or b < 0x250]

    def spell(spans: list[tuple[int, int]]) -> str:
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)

    latin1 = [(a, min(b, 0xFF)) for a, b in kept if a <= 0xFF]
    return f"[^{spell(latin1)}]", f"[^{spell(kept)}]"


_NFKC_QUICK, _NFKC_UNSTABLE = _nfkc_unstable_patterns()


@F.pandas_udf(T.StringType())
def _nfkc_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape_batch(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _plain_batch(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: html.unescape(unicodedata.normalize("NFKC", v)), na_action="ignore"
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _plain_list_batch(values: pd.Series) -> pd.Series:
    return values.map(
        lambda items: [
            None if v is None else html.unescape(unicodedata.normalize("NFKC", v)) for v in items
        ],
        na_action="ignore",
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(value: Column) -> Column:
    """Keep filters on this value above the projection that computes it.

    The optimizer moves a filter below a projection by copying the expressions it
    reads, and would run a whole cleaning chain twice. It never copies an
    expression that depends on the partition, and this condition always holds.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def change_where(
    text: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]
) -> Column:
    """Apply ``change`` only to values that pass ``test``; others are untouched."""
    return let(text, lambda v: F.when(test(v), change(v)).otherwise(v))


def may_hold_hazards(text: Column) -> Column:
    """A cheap test that is true wherever one of the deletion patterns can match."""
    found = text.rlike(_HAZARD_WORDS)
    for mark in reversed(_HAZARD_MARKS):
        found = text.contains(mark) | found
    return found


def delete_patterns(text: Column, patterns: Iterable[str], flags: str) -> Column:
    """Delete each pattern in turn; order is part of the contract."""
    for pattern in patterns:
        text = F.regexp_replace(text, f"(?{flags}){pattern}", "")
    return text


def collapse_whitespace(text: Column) -> Column:
    text = change_where(text, _beyond_latin1, lambda v: F.regexp_replace(v, _WS_OTHER, " "))
    return F.trim(F.regexp_replace(text, _WS_RUN, " "))


def strip_whitespace(text: Column) -> Column:
    return F.trim(text, F.lit(C.WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip_whitespace(text) == "")


def _beyond_latin1(text: Column) -> Column:
    return _not_ascii(text) & text.rlike(r"[^\x00-\xff]")


def _not_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def strip_markup(text: Column, drop_scripts: bool = True) -> Column:
    """Remove tags and comments; block elements leave a line break behind."""

    def strip(value: Column) -> Column:
        if drop_scripts:
            value = F.regexp_replace(value, _SCRIPT_BODIES, "")
        value = F.regexp_replace(value, _BLOCK_START, "\n")
        return F.regexp_replace(value, _MARKUP, "")

    return change_where(text, lambda v: v.contains("<"), strip)


def needs_nfkc(text: Column) -> Column:
    return _not_ascii(text) & text.rlike(_NFKC_QUICK) & text.rlike(_NFKC_UNSTABLE)


def needs_full_unescape(text: Column) -> Column:
    return text.contains("&") & text.rlike(_OTHER_ENTITY)


def unescape_common(text: Column) -> Column:
    """Decode the common entities; ``text`` should be a plain column."""
    decoded = text
    for entity, char in C.COMMON_ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.when(text.contains("&"), decoded).otherwise(text)


def nfkc(text: Column) -> Column:
    """NFKC; ``text`` should be a plain column, it is read more than once."""
    return F.coalesce(_nfkc_batch(F.when(needs_nfkc(text), text)), text)


def unescape(text: Column) -> Column:
    """Decode HTML entities; ``text`` should be a plain column."""
    return F.coalesce(
        _unescape_batch(F.when(needs_full_unescape(text), text)), unescape_common(text)
    )


def plain(text: Column) -> Column:
    """NFKC, then entities; ``text`` should be a plain column."""
    hard = needs_nfkc(text) | needs_full_unescape(text)
    return F.coalesce(_plain_batch(F.when(hard, text)), unescape_common(text))


# Each field cleaner has two halves around the entity decoder. The strict one
# decodes up front, so its first half is `plain` and all markup work follows.


def title_tail(text: Column) -> Column:
    text = change_where(
        text, lambda v: v.contains("<"), lambda v: F.regexp_replace(v, "<[^>]*>", "")
    )
    text = change_where(
        collapse_whitespace(text),
        may_hold_hazards,
        lambda v: delete_patterns(v, C.TITLE_SQL_PATTERNS, "iUd"),
    )
    return F.coalesce(empty_to_null(text), F.lit(C.DEFAULT_TITLE))


def normalize_title(text: Column) -> Column:
    """Display title: markup-free, single-spaced, never empty."""
    return title_tail(strip_markup(plain(text)))


def _anchored(pattern: str) -> str:
    return rf"\b{pattern}" if pattern.startswith("on") else pattern


def delete_active_content(text: Column, anchor: bool = True) -> Column:
    """Delete script and SQL phrases from a summary.

    With ``anchor`` an event handler must start a word, so "condition=" stays.
    """
    scripts = C.SUMMARY_SCRIPT_PATTERNS
    if anchor:
        scripts = tuple(_anchored(p) for p in scripts)
    return change_where(
        text,
        may_hold_hazards,
        lambda v: delete_patterns(
            delete_patterns(v, scripts, "isU"), C.SUMMARY_SQL_PATTERNS, "iUd"
        ),
    )


def summary_tail(text: Column) -> Column:
    return empty_to_null(F.substring(collapse_whitespace(text), 1, C.SUMMARY_MAX_LEN))


def normalize_summary(text: Column) -> Column:
    """Plain-text summary of at most 4000 characters, or null."""
    return summary_tail(delete_active_content(strip_markup(plain(text))))


def normalize_author(text: Column) -> Column:
    """Author without markup, or null."""
    return empty_to_null(strip_whitespace(strip_markup(plain(text))))


def _distinct_ignoring_case(tags: Column) -> Column:
    """Keep the first spelling of each tag."""
    keyed = F.array_sort(
        F.transform(
            tags, lambda t, i: F.struct(F.lower(t).alias("key"), i.alias("i"), t.alias("tag"))
        )
    )
    first = let(
        keyed,
        lambda rows: F.filter(
            rows, lambda row, i: (i == 0) | (row["key"] != F.get(rows, i - 1)["key"])
        ),
    )
    return F.transform(first, lambda row: row["tag"])


def normalize_tags(tags: Column, drop_scripts: bool = True) -> Column:
    """Clean, drop blanks, deduplicate ignoring case, sort by code point."""
    joined = F.array_join(tags, "\n")
    simple = ~joined.contains("<") & ~joined.contains("&") & ~needs_nfkc(joined)
    hard = F.exists(tags, lambda t: needs_nfkc(t) | needs_full_unescape(t))
    decoded = F.coalesce(
        _plain_list_batch(F.when(~simple & hard, tags)), F.transform(tags, unescape_common)
    )
    stripped = F.when(simple, tags).otherwise(
        F.transform(decoded, lambda t: strip_markup(t, drop_scripts))
    )
    cleaned = F.filter(F.transform(stripped, strip_whitespace), lambda t: t != "")
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return F.coalesce(F.array_sort(_distinct_ignoring_case(cleaned)), empty)


def is_suspicious(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(C.SUSPICIOUS_WORDS)), F.lit(False))
