"""Relevance, recency and the final ranking of articles per topic.

Inputs: ``articles`` with article_id, title, body, published_at (and source_id);
``topics`` with topic_id and keywords (array<string>; several words make a
phrase).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions.text import let, settled
from feedlake.functions.tokens import each, words
from feedlake.session import materialize

SCORE_DIGITS = 6
#: A term in more than one of so many articles is common.
COMMON_ONE_IN = 500


def in_window(articles: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Articles published in the ``days`` up to ``as_of``; a prunable range filter."""
    return articles.filter(
        (F.col("published_at") <= as_of)
        & (F.col("published_at") > as_of - F.make_dt_interval(days=F.lit(days)))
    )


def tokens(articles: DataFrame) -> DataFrame:
    """(article_id, field, position, token) of titles and bodies, no stop words."""
    titled = F.transform(
        words(F.col("title")),
        lambda t, i: F.struct(F.lit("title").alias("field"), i.alias("position"), t.alias("token")),
    )
    body = F.transform(
        words(F.col("body")),
        lambda t, i: F.struct(F.lit("body").alias("field"), i.alias("position"), t.alias("token")),
    )
    return (
        articles.select("article_id", each(F.concat(titled, body)).alias("t"))
        .select("article_id", "t.field", "t.position", "t.token")
        .filter(F.col("token").isNotNull() & ~F.col("token").isin(*C.STOP_WORDS))
    )


def topic_terms(topics: DataFrame) -> DataFrame:
    """Distinct (topic_id, term); a term is one keyword or phrase in lower case."""
    return (
        topics.select("topic_id", F.explode("keywords").alias("keyword"))
        .select("topic_id", F.array_join(words(F.col("keyword")), " ").alias("term"))
        .filter((F.col("term") != "") & ~F.col("term").isin(*C.STOP_WORDS))
        .distinct()
    )


def _windows(tokens: Column, size: int) -> Column:
    """Each token with those behind it, ``size`` in all; null beyond the end."""
    return let(tokens, lambda w: F.arrays_zip(*(F.slice(w, k + 1, F.size(w)).alias(f"t{k}") for k in range(size))))


def phrase_occurrences(articles: DataFrame, phrases: DataFrame) -> DataFrame:
    """(article_id, n_words, in_title, term): every place where a phrase stands.

    ``phrases``: term, distinct; words joined by a blank. A place meets the phrases that
    begin with its word, and the words behind decide; no n-grams are made. The longest
    phrase, one number, is asked of the phrases first. Phrases are the small side, which
    Spark broadcasts if it fits its limit.
    """
    wanted = phrases.select("term", F.split("term", " ").alias("w"))
    longest = wanted.agg(F.max(F.size("w"))).first()[0] or 1
    places = articles.select(
        "article_id",
        settled(F.size(words(F.col("title")))).alias("n_title"),
        _windows(words(F.col("title")), longest).alias("title_places"),
        _windows(words(F.col("body")), longest).alias("body_places"),
    ).select(
        "article_id",
        "n_title",
        (F.size("title_places") + F.size("body_places")).alias("n_words"),
        F.posexplode_outer(F.concat("title_places", "body_places")).alias("position", "t"),
    )
    same = F.col("t")["t0"] == F.col("w")[0]
    for k in range(1, longest):
        same = same & ((F.size("w") <= k) | F.coalesce(F.col("t")[f"t{k}"] == F.get("w", F.lit(k)), F.lit(False)))
    found = places.join(wanted, same)
    return found.select("article_id", "n_words", (F.col("position") < F.col("n_title")).alias("in_title"), "term")


def keyword_score(
    articles: DataFrame, topics: DataFrame, settings: C.RankingSettings = C.RankingSettings()
) -> DataFrame:
    """(topic_id, article_id, relevance): weighted term frequency over length.

    Places where no topic's term stands drop out at once, the rest is summed per
    (article, term), and only then do terms meet topics: a term shared by many topics
    multiplies sums, not occurrences. Phrases may have any number of words.
    """
    terms = topic_terms(topics)
    occurrences = phrase_occurrences(articles, terms.select("term").distinct())
    per_term = occurrences.groupBy("article_id", "n_words", "term").agg(
        F.sum(F.when(F.col("in_title"), settings.title_weight).otherwise(1.0)).alias("weight")
    )
    return (
        per_term.join(terms, "term")
        .groupBy("topic_id", "article_id")
        .agg((F.sum("weight") / F.max("n_words")).alias("relevance"))
        .withColumn("relevance", F.round("relevance", SCORE_DIGITS))
    )


def term_counts(articles: DataFrame) -> DataFrame:
    """(article_id, term, tf) over title and body without stop words.

    Where the rows of an article lie in one partition (``session.gathered``), its words
    are counted there and nothing is shuffled; otherwise each (article, term) is, once.
    """
    return (
        articles.select(
            "article_id",
            each(F.concat(words(F.col("title")), words(F.col("body")))).alias("term"),
        )
        .filter(F.col("term").isNotNull() & ~F.col("term").isin(*C.STOP_WORDS))
        .groupBy("article_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def idf_snapshot(counts: DataFrame, articles: DataFrame) -> DataFrame:
    """(term, idf) of a corpus; write it to a table to freeze it for a run.

    idf = ln((1 + N) / (1 + df)) + 1.
    """
    n_articles = articles.agg(F.count(F.lit(1))).scalar()
    return idf_of(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_articles)


def idf_of(frequencies: DataFrame, n_articles: Column | int) -> DataFrame:
    """(term, idf) of document frequencies (term, df)."""
    count = n_articles if isinstance(n_articles, Column) else F.lit(n_articles)
    return frequencies.select("term", (F.log((1 + count) / (1 + F.col("df"))) + 1).alias("idf"))


def _weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(article_id, w): the weight of every term of an article.

    Terms that more than one article in COMMON_ONE_IN has are most of the rows, and at most
    COMMON_ONE_IN times as many as an article has on average, however many articles there
    are. That list Spark sends to the rows; only rows of rarer terms are shuffled.
    """
    common = materialize(idf.where(F.col("idf") < math.log(COMMON_ONE_IN) + 1), "common")
    marked = counts.join(common, "term", "left")
    w = (F.col("tf") * F.col("idf")).alias("w")
    rare = idf.where(~(F.col("idf") < math.log(COMMON_ONE_IN) + 1))
    rarer = marked.where("idf is null").drop("idf").join(rare, "term")
    # Rows, not sums, are put together: parts of a union of sums by article may be kept apart.
    return marked.where("idf is not null").select("article_id", w).unionByName(rarer.select("article_id", w))


def tfidf_score(
    articles: DataFrame, topics: DataFrame, idf: DataFrame | None = None
) -> DataFrame:
    """(topic_id, article_id, relevance): cosine of TF-IDF vectors.

    The topic is a pseudo-document of its keywords' words. Only topic terms
    reach the product; the article norms need every term once. Texts are read once:
    the counts are written out, and so is the IDF, which stays fixed for the run.
    """
    counts = materialize(term_counts(articles), "term-counts")
    if idf is None:
        idf = materialize(idf_snapshot(counts, articles), "idf")
    norms = _weights(counts, idf).groupBy("article_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    topic_words = (
        topic_terms(topics)
        .select("topic_id", F.explode(F.split("term", " ")).alias("term"))
        .filter(~F.col("term").isin(*C.STOP_WORDS))
        .groupBy("topic_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    topic_weights = topic_words.join(idf, "term").select(
        "topic_id", "term", "idf", (F.col("tf") * F.col("idf")).alias("tw")
    )
    topic_norms = topic_weights.groupBy("topic_id").agg(
        F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("topic_norm")
    )
    # One join per shuffle on the term: a hot term can then be split.
    products = (
        counts.join(topic_weights, "term")
        .groupBy("topic_id", "article_id")
        .agg(F.sum(F.col("tf") * F.col("idf") * F.col("tw")).alias("dot"))
    )
    return (
        products.join(norms, "article_id")
        .join(topic_norms, "topic_id")
        .select(
            "topic_id",
            "article_id",
            F.round(
                F.col("dot") / (F.col("norm") * F.col("topic_norm")), SCORE_DIGITS
            ).alias("relevance"),
        )
    )


def recency_boost(published_at: Column, as_of: Column, halflife_hours: float = 48.0) -> Column:
    """1 for new articles, halved every ``halflife_hours``; never above 1."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published_at.cast("timestamp"))
    hours = F.greatest(micros / F.lit(3_600_000_000.0), F.lit(0.0))
    return F.exp(-F.log(F.lit(2.0)) * hours / F.lit(halflife_hours))


def _weighted(column: str, weight: float) -> Column:
    """Exact decimal product, so that no order of addition can change a rank."""
    return F.col(column).cast(f"decimal(18,{SCORE_DIGITS})") * F.lit(str(weight)).cast(
        "decimal(8,4)"
    )


def final_score(
    relevance: DataFrame,
    articles: DataFrame,
    as_of: Column,
    settings: C.RankingSettings = C.RankingSettings(),
    sources: DataFrame | None = None,
) -> DataFrame:
    """Relevance and recency combined; with ``sources`` also their credibility."""
    facts = articles.select(
        "article_id", "published_at", *(["source_id"] if sources is not None else [])
    )
    scored = relevance.join(facts, "article_id").withColumn(
        "recency",
        F.round(
            recency_boost(F.col("published_at"), as_of, settings.halflife_hours), SCORE_DIGITS
        ),
    )
    total = _weighted("relevance", settings.weight_relevance) + _weighted(
        "recency", settings.weight_recency
    )
    if sources is not None:
        scored = scored.join(
            sources.select(F.col("id").alias("source_id"), "credibility_score"), "source_id", "left"
        ).withColumn(
            "credibility_score", F.coalesce("credibility_score", F.lit(C.DEFAULT_CREDIBILITY))
        )
        total = total + _weighted("credibility_score", settings.weight_credibility)
    return scored.withColumn("score", F.round(total, SCORE_DIGITS).cast("double"))


def top_per_topic(scored: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` best articles per topic; ties by newer, then smaller id.

    Spark applies the limit per task before the shuffle, so a topic matching a
    third of all articles still ships at most ``n`` rows per task.
    """
    order = Window.partitionBy("topic_id").orderBy(
        F.col("score").desc(), F.col("published_at").desc(), F.col("article_id").asc()
    )
    return scored.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def rank_articles(
    articles: DataFrame,
    topics: DataFrame,
    as_of: Column,
    mode: str = "keywords",
    settings: C.RankingSettings = C.RankingSettings(),
    sources: DataFrame | None = None,
) -> DataFrame:
    """Top articles per topic in one of two modes: ``keywords`` or ``tfidf``."""
    recent = in_window(articles, as_of, settings.window_days)
    if mode == "keywords":
        relevance = keyword_score(recent, topics, settings)
    elif mode == "tfidf":
        relevance = tfidf_score(recent, topics)
    else:
        raise ValueError(f"unknown ranking mode {mode!r}")
    return top_per_topic(
        final_score(relevance, recent, as_of, settings, sources), settings.top_n
    )
