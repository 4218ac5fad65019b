"""Schemas of the article tables, feed entries and source lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _audited(*fields: T.StructField) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", T.LongType(), False),
            *fields,
            T.StructField("created_at", T.TimestampType(), False),
            T.StructField("updated_at", T.TimestampType(), False),
        ]
    )


def _col(name: str, data_type: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, data_type, nullable)


_STRINGS = T.ArrayType(T.StringType(), containsNull=False)

USERS = _audited(_col("email", T.StringType()), _col("is_active", T.BooleanType()))

SOURCES = _audited(
    _col("name", T.StringType()),
    _col("url", T.StringType()),
    _col("feed_url", T.StringType()),
    _col("credibility_score", T.DoubleType()),
    _col("is_active", T.BooleanType()),
    _col("last_fetched_at", T.TimestampType(), True),
    _col("last_error", T.StringType(), True),
    _col("error_count", T.IntegerType()),
)

TOPICS = _audited(
    _col("user_id", T.LongType()),
    _col("name", T.StringType()),
    _col("keywords", _STRINGS),
    _col("is_active", T.BooleanType()),
)

ARTICLES = _audited(
    _col("source_id", T.LongType()),
    _col("title", T.StringType()),
    _col("link", T.StringType()),
    _col("summary_raw", T.StringType(), True),
    _col("content_hash", T.StringType()),
    _col("published_at", T.TimestampType()),
    _col("author", T.StringType(), True),
    _col("tags", _STRINGS),
)

ARTICLE_SUMMARIES = _audited(
    _col("article_id", T.LongType()),
    _col("summary_text", T.StringType()),
    _col("model", T.StringType()),
    _col("tokens_used", T.IntegerType()),
)

DELIVERIES = _audited(
    _col("user_id", T.LongType()),
    _col("topic_id", T.LongType()),
    _col("article_id", T.LongType()),
    _col("delivery_date", T.DateType()),
    _col("position", T.IntegerType()),
)

FEEDBACK = _audited(
    _col("delivery_id", T.LongType()),
    _col("rating", T.StringType()),
    _col("comment", T.StringType(), True),
)

TABLES: dict[str, T.StructType] = {
    "users": USERS,
    "sources": SOURCES,
    "topics": TOPICS,
    "articles": ARTICLES,
    "article_summaries": ARTICLE_SUMMARIES,
    "deliveries": DELIVERIES,
    "feedback": FEEDBACK,
}

MAX_LENGTHS: dict[str, dict[str, int]] = {
    "users": {"email": 255},
    "sources": {"name": 255, "url": 512, "feed_url": 512, "last_error": 1024},
    "topics": {"name": 255},
    "articles": {"title": 512, "link": 1024, "content_hash": 64, "author": 255},
    "article_summaries": {"model": 50},
}


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` must be found in ``parent.id``."""

    child: str
    column: str
    parent: str


FOREIGN_KEYS = (
    ForeignKey("topics", "user_id", "users"),
    ForeignKey("articles", "source_id", "sources"),
    ForeignKey("article_summaries", "article_id", "articles"),
    ForeignKey("deliveries", "user_id", "users"),
    ForeignKey("deliveries", "topic_id", "topics"),
    ForeignKey("deliveries", "article_id", "articles"),
    ForeignKey("feedback", "delivery_id", "deliveries"),
)

UNIQUE_KEYS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("users", ("email",)),
    ("sources", ("url",)),
    ("sources", ("feed_url",)),
    ("articles", ("content_hash",)),
    ("article_summaries", ("article_id", "model")),
    ("deliveries", ("topic_id", "delivery_date", "article_id")),
    ("deliveries", ("topic_id", "delivery_date", "position")),
    ("feedback", ("delivery_id",)),
)

# One row per feed entry, whatever the feed dialect.
ENTRY = T.StructType(
    [
        T.StructField("feed_path", T.StringType()),
        T.StructField("feed_time", T.TimestampType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField(
            "links",
            T.ArrayType(
                T.StructType(
                    [T.StructField("rel", T.StringType()), T.StructField("href", T.StringType())]
                )
            ),
        ),
        T.StructField("summary", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("published", T.StringType()),
        T.StructField("updated", T.StringType()),
        T.StructField("corrupt_record", T.StringType()),
    ]
)

SOURCE_LIST = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("feed_url", T.StringType()),
        T.StructField("credibility_score", T.DoubleType()),
        T.StructField("is_active", T.BooleanType()),
    ]
)
