"""Word rules and id arithmetic that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: The same, with every byte that is no ASCII digit, letter or part of a non-ASCII
#: character turned into a space.
ALNUM = bytes(
    LOWER[b] if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)
)


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text, as UTF-8 bytes."""
    return (text or "").encode().translate(LOWER).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return (text or "").encode().translate(ALNUM).split()


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def byte_slices(texts: list[str | None], limit: int = 4 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of texts as (first, end, lower-cased UTF-8) of about ``limit`` bytes: a batch of
    long texts is worked on in parts. One longer text is a run of its own; null is empty."""
    first, size, held = 0, 0, []
    for k, text in enumerate(texts):
        data = (text or "").encode().translate(LOWER)
        if held and size + len(data) > limit:
            yield first, k, held
            first, size, held = k, 0, []
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, len(texts), held


def free_name(rows: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores behind it until no column has that name."""
    taken = {c.lower() for c in rows.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
