"""Tokens, n-grams and sentences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions.text import let, strip_whitespace

_WORD = r"([\p{L}\p{N}_]+)"
_SENTENCE = r"([^.!?]+[.!?]*)"


def words(text: Column) -> Column:
    """Lower-case words in order; everything that is no letter or digit separates.

    The text should have been NFKC-normalised (cleaned titles and summaries are).
    """
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(1))


def without_stop_words(tokens: Column, stop_words: tuple[str, ...] = C.STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def each(items: Column) -> Column:
    """One row per item, and one null row for none: filter nulls afterwards.

    The plain generator makes Spark test the array for emptiness ahead of it,
    which would compute the array twice.
    """
    return F.explode_outer(items)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` consecutive tokens joined by a blank."""
    if n == 1:
        return tokens

    def joined(items: Column) -> Column:
        starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - (n - 1)))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), " "))
        return F.coalesce(grams, F.array().cast("array<string>"))

    return let(tokens, joined)


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences."""
    parts = F.transform(
        F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(1)), strip_whitespace
    )
    return F.filter(parts, lambda s: s.rlike(r"[\p{L}\p{N}]"))
