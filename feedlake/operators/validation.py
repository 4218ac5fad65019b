"""Validation as data: every row carries the list of rules it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake import schemas
from feedlake.functions.text import is_blank, settled
from feedlake.functions.urls import url_scheme


def _violations(rules: dict[str, Column]) -> Column:
    checks = [F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()]
    return F.array_compact(F.array(*checks))


def _too_long(table: str) -> dict[str, Column]:
    return {
        f"{name}_too_long": F.coalesce(F.length(F.col(name)) > limit, F.lit(False))
        for name, limit in schemas.MAX_LENGTHS[table].items()
    }


def article_violations(check_lengths: bool = False) -> Column:
    """Rules for article rows, in a fixed order.

    ``check_lengths`` adds the column lengths of the table, which only some
    stores enforce.
    """
    rules = {
        "source_id": F.col("source_id").isNull() | (F.col("source_id") <= 0),
        "title": is_blank(F.col("title")),
        "link": is_blank(F.col("link")),
        "content_hash": F.length("content_hash") != 64,
        "published_at": F.col("published_at").isNull(),
        "tags": F.exists(F.col("tags"), lambda t: t.isNull()),
    }
    if check_lengths:
        rules |= {k: v for k, v in _too_long("articles").items() if k != "content_hash_too_long"}
    return _violations(rules)


def validate_articles(articles: DataFrame, check_lengths: bool = False) -> DataFrame:
    """Add ``violations`` and the ``link_scheme_ok`` warning.

    Entries that could not be read (``corrupt_record``, if there is such a column) break
    the rule of that name, whatever their fields look like.
    """
    found = article_violations(check_lengths)
    if "corrupt_record" in articles.columns:
        damaged = F.when(F.col("corrupt_record").isNotNull(), F.array(F.lit("corrupt_record")))
        found = F.concat(F.coalesce(damaged, F.array().cast("array<string>")), found)
    return articles.withColumns(
        {
            "violations": settled(found),
            "link_scheme_ok": url_scheme(F.col("link")).isin(*C.ALLOWED_URL_SCHEMES),
        }
    )


def source_violations() -> Column:
    score = F.col("credibility_score")
    return _violations(
        {
            "name": is_blank(F.col("name")),
            "url": is_blank(F.col("url")),
            "feed_url": is_blank(F.col("feed_url")),
            "credibility_score": F.coalesce((score < 0.0) | (score > 1.0), F.lit(False))
            | F.isnan(F.coalesce(score, F.lit(0.0))),
        }
    )


def validate_sources(sources: DataFrame) -> DataFrame:
    return sources.withColumn("violations", source_violations())


def require_valid(rows: DataFrame) -> DataFrame:
    """Strict mode: the job fails on the first row with a violation."""
    message = F.concat(F.lit("invalid row: "), F.array_join("violations", ", "))
    ok = F.when(F.size("violations") > 0, F.raise_error(message).cast("boolean")).otherwise(True)
    return rows.filter(ok)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("violations") == 0).drop("violations")


def rejected(rows: DataFrame) -> DataFrame:
    """Rows for the quarantine table, with their reasons."""
    return rows.filter(F.size("violations") > 0)
