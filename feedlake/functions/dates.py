"""Publication dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake.functions.text import let, strip_whitespace

_WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
_ZONE = r"(?:\s*(Z|[A-Za-z]{2,5}|[+-]\d{2}(?::?\d{2})?))?$"
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _offset(text: Column) -> Column:
    """Numeric offset of the text; names other than offsets count as UTC."""
    digits = F.replace(F.regexp_extract(text, r"[+-]\d{2}(:?\d{2})?$", 0), F.lit(":"), F.lit(""))
    return F.when(digits == "", F.lit("+0000")).otherwise(F.rpad(digits, 5, "0"))


def _with_century(text: Column) -> Column:
    """"15 Jan 23" to four digits: years to 68 are of this century, as RFC 2822 reads them."""
    shape = r"^(\d{1,2}[\s-][A-Za-z]{3,9}[\s-])(\d{2})(?=\s|$)"
    century = F.when(F.regexp_extract(text, shape, 2) <= "68", F.lit("20")).otherwise(F.lit("19"))
    year = F.concat(F.regexp_extract(text, shape, 1), century, F.regexp_extract(text, shape, 2))
    return F.when(text.rlike(shape), F.concat(year, F.regexp_replace(text, shape, ""))).otherwise(text)


def _slashes(text: Column) -> Column:
    """"1/15/2023 ..." to "Jan 15, 2023 ..." or "15 Jan 2023 ...", the month first unless
    only the second number can be one."""
    shape = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?=\s|$)"
    one, two = (F.regexp_extract(text, shape, k).try_cast("int") for k in (1, 2))
    swapped = (one > 12) & (two <= 12)
    month, day = F.when(swapped, two).otherwise(one), F.when(swapped, one).otherwise(two)
    name = F.get(F.array(*map(F.lit, _MONTHS)), month - 1)
    year, rest = F.regexp_extract(text, shape, 3), F.regexp_replace(text, shape, "")
    with_half = text.rlike(r"(?i)[ap]m\b")
    us = F.concat(name, F.lit(" "), day.cast("string"), F.lit(", "), year, rest)
    plain = F.concat(day.cast("string"), F.lit(" "), name, F.lit(" "), year, rest)
    return F.when(text.rlike(shape), F.when(with_half, us).otherwise(plain)).otherwise(text)


def _common_shape(text: Column) -> Column:
    """Shapes that differ from a known one in arrangement only, rearranged. Steps that use
    their input several times get it through ``let``: the chain before is one copy."""
    text = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    text = F.regexp_replace(text, r"^(\d{4})/(\d{2})/(\d{2})(?=\s|T|$)", "$1-$2-$3")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(?!\d)", "$1-$2-$3T$4:$5")
    asctime = r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s+(\d{4})$"
    text = F.regexp_replace(text, asctime, "$2 $1 $4 $3")
    return let(let(text, _with_century), _slashes)


def _parse(text: Column, shape: str, head: str, pattern: str) -> Column:
    """Try one shape: only matching text reaches the (slow to fail) parser."""
    body = F.regexp_replace(F.regexp_extract(text, head, 1), r"[\sT]+", " ")
    stamped = F.concat(body, F.lit(" "), _offset(F.regexp_extract(text, head, 2)))
    return F.when(text.rlike(shape), F.try_to_timestamp(stamped, F.lit(pattern + " xx")))


def parse_published(text: Column) -> Column:
    """UTC timestamp of a feed date, or null when blank or not understood.

    Understood: RFC-822 with two or four digits of the year (the weekday is ignored),
    ISO dates and times in extended and basic form, asctime, slash dates with the month
    first, and "January 15, 2023 10:00 AM". Offsets may name hours only; fractions are
    cut to microseconds. Times without an offset are UTC.
    """
    time = r"\d{1,2}:\d{2}(?::\d{2})?"
    iso_head = rf"^(\d{{4}}-\d{{2}}-\d{{2}}(?:[T\s]+{time}(?:\.\d{{1,6}})?)?){_ZONE}"
    rfc_head = rf"^(\d{{1,2}}[\s-][A-Za-z]{{3}}[\s-]\d{{4}}(?:\s+{time})?){_ZONE}"
    rfc_long_head = rf"^(\d{{1,2}}\s[A-Za-z]{{4,9}}\s\d{{4}}(?:\s+{time})?){_ZONE}"
    us_head = rf"(?i)^([A-Za-z]{{3,9}}\s+\d{{1,2}},\s+\d{{4}}(?:\s+{time}\s*[AP]M)?){_ZONE}"

    def attempt(value: Column) -> Column:
        return F.coalesce(
            _parse(value, iso_head, iso_head, "yyyy-MM-dd[ H:mm[:ss][.SSSSSS][.SSS]]"),
            F.when(value.rlike(r"^\d{1,2}[\s-][A-Za-z]"), let(F.initcap(value), in_words)),
            F.when(value.rlike(r"^[A-Za-z]"), let(halves(F.initcap(value)), month_first)),
        )

    def in_words(value: Column) -> Column:
        return F.coalesce(
            _parse(value, rfc_head, rfc_head, "d[ ][-]MMM[ ][-]yyyy[ H:mm[:ss]]"),
            _parse(value, rfc_long_head, rfc_long_head, "d MMMM yyyy[ H:mm[:ss]]"),
        )

    def halves(us: Column) -> Column:
        us = F.regexp_replace(us, r"(?i)\s*\b([AP])M\b", " $1M")
        us = F.regexp_replace(us, r"\bam\b|\bAm\b|\baM\b", "AM")
        return F.regexp_replace(us, r"\bpm\b|\bPm\b|\bpM\b", "PM")

    def month_first(us: Column) -> Column:
        return F.coalesce(
            _parse(us, us_head, us_head, "MMMM d, yyyy[ h:mm[:ss] a]"),
            _parse(us, us_head, us_head, "MMM d, yyyy[ h:mm[:ss] a]"),
        )

    bare = F.regexp_replace(strip_whitespace(text), _WEEKDAY, "")
    return let(let(bare, _common_shape), attempt)


def published_or_run_date(text: Column, run_date: Column) -> tuple[Column, Column]:
    """(timestamp, fallback flag): midnight of ``run_date`` stands in."""
    parsed = parse_published(text)
    midnight = F.date_trunc("day", run_date.cast("timestamp"))
    return F.coalesce(parsed, midnight), parsed.isNull()


def iso_utc(moment: Column) -> Column:
    """ISO 8601 with a +00:00 offset; microseconds only when there are any."""
    fraction = F.date_format(moment, ".SSSSSS")
    return F.concat(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == ".000000", F.lit("")).otherwise(fraction),
        F.lit("+00:00"),
    )
