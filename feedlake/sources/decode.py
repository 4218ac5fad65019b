"""Charset audit and decoding of payload bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import config as C

_REPLACEMENT = "�"


@F.pandas_udf(T.StringType())
def _decode_windows_1252(values: pd.Series) -> pd.Series:
    return values.map(
        lambda b: bytes(b).decode("cp1252", errors="replace"), na_action="ignore"
    )


def charset_of(content: Column) -> dict[str, Column]:
    """``charset`` and the ``rule`` that named it.

    The whole payload is judged, its declaration up to its end: byte-order mark, then UTF-8 validity, then the
    charset its XML declaration names, then the presence of C1 bytes, which
    ISO-8859-1 text does not use and windows-1252 text does.
    """
    latin = F.decode(content, "ISO-8859-1")
    head = F.substring_index(latin, "?>", 1)
    declared = F.lower(F.regexp_extract(head, r"""<\?xml[^>]*encoding=["']([A-Za-z0-9_-]+)""", 1))
    mark = F.hex(F.substring(content, 1, 3))
    valid_utf8 = F.is_valid_utf8(content.cast("string"))
    usable = declared.isin(*C.ALLOWED_ENCODINGS) & ~declared.isin("utf-8", "ascii")
    rule = (
        F.when(mark.startswith("FEFF") | mark.startswith("FFFE"), F.lit("utf16_mark"))
        .when(mark == "EFBBBF", F.lit("utf8_mark"))
        .when(~latin.rlike(r"[^\x00-\x7f]"), F.lit("all_ascii"))
        .when(valid_utf8, F.lit("valid_utf8"))
        .when(usable, F.lit("declared"))
        .when((declared != "") & ~declared.isin(*C.ALLOWED_ENCODINGS), F.lit("not_allowed"))
        .when(latin.rlike(r"[\x80-\x9f]"), F.lit("c1_bytes"))
        .otherwise(F.lit("latin_bytes"))
    )
    charset = (
        F.when(F.col("rule") == "utf16_mark", F.lit("utf-16"))
        .when(F.col("rule").isin("utf8_mark", "valid_utf8", "not_allowed"), F.lit("utf-8"))
        .when(F.col("rule") == "all_ascii", F.lit("ascii"))
        .when(F.col("rule") == "declared", declared)
        .when(F.col("rule") == "c1_bytes", F.lit("windows-1252"))
        .otherwise(F.lit("iso-8859-1"))
    )
    return {"rule": rule, "charset": charset}


def decode_payloads(payloads: DataFrame, content: str = "content") -> DataFrame:
    """Add rule, charset, text and n_replaced (characters lost to bad bytes)."""
    raw = F.col(content)
    named = charset_of(raw)
    judged = payloads.withColumn("rule", named["rule"]).withColumn("charset", named["charset"])
    charset = F.col("charset")
    utf8 = F.make_valid_utf8(raw.cast("string"))
    decoded = (
        F.when(charset == "utf-16", F.decode(raw, "UTF-16"))
        .when(F.col("rule") == "utf8_mark", F.regexp_replace(utf8, "^﻿", ""))
        .when(charset.isin("utf-8", "ascii"), utf8)
        .when(charset == "iso-8859-1", F.decode(raw, "ISO-8859-1"))
    )
    cp1252 = _decode_windows_1252(F.when(charset == "windows-1252", raw))
    return judged.withColumn("text", F.coalesce(decoded, cp1252)).withColumn(
        "n_replaced",
        F.length("text") - F.length(F.replace(F.col("text"), F.lit(_REPLACEMENT), F.lit(""))),
    )


def charset_audit(decoded: DataFrame) -> DataFrame:
    """How many payloads each rule decided and how many characters were lost."""
    return decoded.groupBy("charset", "rule").agg(
        F.count(F.lit(1)).alias("n_payloads"),
        F.sum("n_replaced").cast("long").alias("n_replaced"),
        F.sum(F.length("text")).cast("long").alias("n_chars"),
    )


def is_encoding_allowed(charset: Column) -> Column:
    return F.lower(charset).isin(*C.ALLOWED_ENCODINGS)
