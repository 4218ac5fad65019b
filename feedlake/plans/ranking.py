"""Queries over ranking, daily picks and feedback learning.

Documents are the articles, benchmark items the topics, labels the feedback.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions.tokens import without_stop_words, words
from feedlake.operators import deliveries, ranking
from feedlake.operators.idf import IdfStore
from feedlake.plans import inputs as I
from feedlake.plans import sqltext as S
from feedlake.plans.registry import query
from feedlake.session import materialize, scratch_path

# The window covers all articles of the supplied tables.
SETTINGS = C.RankingSettings(window_days=31)

_ARTICLES = rf"""
articles AS (
  SELECT doc_id AS article_id, replace(source, 'src', '')::BIGINT AS source_id,
         {S.words("split_part(text, chr(10), 1)")} AS tw,
         {S.words(r"regexp_replace(text, '^[^\n]*\n?', '')")} AS bw,
         TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37 % 43200)::INT) AS published_at
  FROM documents)
"""

_TERMS = f"""
topic_words AS (SELECT item_id AS topic_id, {S.words('text')} AS w FROM benchmark),
topic_terms AS (
  SELECT DISTINCT topic_id, term FROM (
    SELECT topic_id, unnest(w) AS term FROM topic_words
    UNION ALL SELECT topic_id, array_to_string(w[1:n], ' ') FROM topic_words, range(2, 6) t(n))
  WHERE term NOT IN ({S.STOP_LIST}) AND term <> '')
"""

_KEYWORDS = f"""{_ARTICLES}, {_TERMS},
grams AS (
  SELECT article_id, unnest(list_transform(range(1, len(tw) - n + 2),
                                           lambda i: array_to_string(tw[i:i + n - 1], ' '))) AS term, 2.0 AS weight
  FROM articles, range(1, 6) t(n)
  UNION ALL
  SELECT article_id, unnest(list_transform(range(1, len(bw) - n + 2),
                                           lambda i: array_to_string(bw[i:i + n - 1], ' '))), 1.0
  FROM articles, range(1, 6) t(n)),
relevance AS (
  SELECT topic_id, article_id,
         round(sum(weight)::DOUBLE / any_value(len(tw) + len(bw)), 6) AS relevance
  FROM grams JOIN topic_terms USING (term) JOIN articles USING (article_id)
  GROUP BY topic_id, article_id)
"""

_RECENCY = (
    "round(exp(-ln(2) * greatest(epoch_us(TIMESTAMP '2024-01-31') - epoch_us({0}), 0)"
    " / 3600000000.0 / 48), 6)"
)

_SCORED = f"""
facts AS (
  SELECT topic_id, article_id, source_id, published_at, relevance,
         {_RECENCY.format('published_at')} AS recency
  FROM relevance JOIN articles USING (article_id)),
scored AS (
  SELECT *, round(relevance::DECIMAL(18, 6) * 0.7::DECIMAL(8, 4)
                  + recency::DECIMAL(18, 6) * 0.3::DECIMAL(8, 4), 6)::DOUBLE AS score
  FROM facts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY topic_id
                               ORDER BY score DESC, published_at DESC, article_id) AS r
  FROM scored)
"""

_TFIDF = f"""{_ARTICLES}, {_TERMS},
counts AS (
  SELECT article_id, term, count(*) AS tf
  FROM (SELECT article_id, unnest(tw || bw) AS term FROM articles)
  WHERE term NOT IN ({S.STOP_LIST}) GROUP BY ALL),
idf AS (
  SELECT term, ln((1 + (SELECT count(*) FROM articles)) / (1 + count(*))) + 1 AS idf
  FROM counts GROUP BY term),
weights AS (SELECT article_id, term, tf * idf AS w FROM counts JOIN idf USING (term)),
norms AS (SELECT article_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY article_id),
topic_tf AS (
  SELECT topic_id, term, count(*) AS tf
  FROM (SELECT topic_id, unnest(string_split(term, ' ')) AS term FROM topic_terms)
  WHERE term NOT IN ({S.STOP_LIST}) GROUP BY ALL),
topic_weights AS (SELECT topic_id, term, tf * idf AS tw FROM topic_tf JOIN idf USING (term)),
topic_norms AS (SELECT topic_id, sqrt(sum(tw * tw)) AS tnorm FROM topic_weights GROUP BY topic_id),
relevance AS (
  SELECT topic_id, article_id, round(sum(w * tw) / any_value(norm * tnorm), 6) AS relevance
  FROM weights JOIN topic_weights USING (term) JOIN norms USING (article_id)
  JOIN topic_norms USING (topic_id)
  GROUP BY topic_id, article_id)
"""


@query(
    "tokens",
    f"""WITH {_ARTICLES}
        SELECT field, token, count(*) AS n, count(DISTINCT article_id) AS n_articles,
               min(position)::INT AS first_position
        FROM (SELECT article_id, 'title' AS field, unnest(tw) AS token,
                     generate_subscripts(tw, 1) - 1 AS position FROM articles
              UNION ALL SELECT article_id, 'body', unnest(bw), generate_subscripts(bw, 1) - 1
              FROM articles)
        WHERE token NOT IN ({S.STOP_LIST}) GROUP BY ALL""",
)
def tokens(spark, sf):
    per_article = (
        ranking.tokens(I.ranked_articles(spark, sf))
        .groupBy("field", "token", "article_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position"))
    )
    return per_article.groupBy("field", "token").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_articles"),
        F.min("first_position").alias("first_position"),
    )


@query(
    "keyword_score",
    f"WITH {_KEYWORDS} SELECT topic_id, article_id, relevance FROM relevance",
)
def keyword_score(spark, sf):
    return ranking.keyword_score(I.ranked_articles(spark, sf), I.topics(spark, sf), SETTINGS)


@query("tfidf_score", f"WITH {_TFIDF} SELECT topic_id, article_id, relevance FROM relevance")
def tfidf_score(spark, sf):
    return ranking.tfidf_score(I.ranked_articles(spark, sf), I.topics(spark, sf))


@query("tfidf_frozen", f"WITH {_TFIDF} SELECT topic_id, article_id, relevance FROM relevance")
def tfidf_frozen(spark, sf):
    """The same scores with the IDF of a store, which a second call reads as it is."""
    articles, store = I.ranked_articles(spark, sf), IdfStore(spark, scratch_path(spark, "idf"))
    bounds = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp")
    store.frozen(articles, *bounds)
    return ranking.tfidf_score(articles, I.topics(spark, sf), store.frozen(articles, *bounds))


@query("recency_boost", f"SELECT event_id, {_RECENCY.format('ts')} AS recency FROM events")
def recency_boost(spark, sf):
    boost = ranking.recency_boost(F.col("ts"), I.run_date())
    return I.table(spark, sf, "events").select("event_id", F.round(boost, 6).alias("recency"))


_RANKED_OUT = """SELECT topic_id, article_id, relevance, recency, score, r::INT AS rank
    FROM ranked WHERE r <= 10"""
_RANKED_COLUMNS = ("topic_id", "article_id", "relevance", "recency", "score", "rank")


@query("rank_topic_articles", f"WITH {_KEYWORDS}, {_SCORED} {_RANKED_OUT}")
def rank_topic_articles(spark, sf):
    return ranking.rank_articles(
        I.ranked_articles(spark, sf), I.topics(spark, sf), I.run_date(), "keywords", SETTINGS
    ).select(*_RANKED_COLUMNS)


@query("rank_topic_articles_tfidf", f"WITH {_TFIDF}, {_SCORED} {_RANKED_OUT}")
def rank_topic_articles_tfidf(spark, sf):
    return ranking.rank_articles(
        I.ranked_articles(spark, sf), I.topics(spark, sf), I.run_date(), "tfidf", SETTINGS
    ).select(*_RANKED_COLUMNS)


_CREDIBLE = f"""
facts AS (
  SELECT topic_id, article_id, published_at, relevance,
         {_RECENCY.format('published_at')} AS recency,
         coalesce(round((s_acctbal + 1000) / 11000, 4), 0.5) AS cred
  FROM relevance JOIN articles USING (article_id) LEFT JOIN supplier ON s_suppkey = source_id),
scored AS (
  SELECT *, round(relevance::DECIMAL(18, 6) * 0.7::DECIMAL(8, 4)
                  + recency::DECIMAL(18, 6) * 0.3::DECIMAL(8, 4)
                  + cred::DECIMAL(18, 6) * 0.2::DECIMAL(8, 4), 6)::DOUBLE AS score
  FROM facts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY topic_id
                               ORDER BY score DESC, published_at DESC, article_id) AS r
  FROM scored)
"""


@query(
    "rank_with_credibility",
    f"""WITH {_KEYWORDS}, {_CREDIBLE}
        SELECT topic_id, article_id, cred AS credibility_score, score, r::INT AS rank
        FROM ranked WHERE r <= 10""",
)
def rank_with_credibility(spark, sf):
    return ranking.rank_articles(
        I.ranked_articles(spark, sf),
        I.topics(spark, sf),
        I.run_date(),
        "keywords",
        SETTINGS,
        I.credibility_sources(spark, sf),
    ).select("topic_id", "article_id", "credibility_score", "score", "rank")


_NO_DELIVERIES = "topic_id long, article_id long, delivery_date date"


def _two_days(spark, sf):
    """Yesterday's and today's picks out of the same candidates."""
    articles = ranking.in_window(
        I.ranked_articles(spark, sf), I.run_date(), SETTINGS.window_days
    )
    relevance = ranking.keyword_score(articles, I.topics(spark, sf), SETTINGS)
    scored = materialize(
        ranking.final_score(relevance, articles, I.run_date(), SETTINGS), "candidates"
    )
    nothing = spark.createDataFrame([], _NO_DELIVERIES)
    yesterday = deliveries.daily_picks(scored, nothing, F.to_date(F.lit("2024-01-30")))
    today = deliveries.daily_picks(
        scored,
        yesterday.select("topic_id", "article_id", "delivery_date"),
        F.to_date(F.lit("2024-01-31")),
    )
    return yesterday, today


@query(
    "daily_top3",
    f"""WITH {_KEYWORDS}, {_SCORED}
        SELECT topic_id, article_id, score, (r - 3)::INT AS position, '2024-01-31' AS delivery_date
        FROM ranked WHERE r BETWEEN 4 AND 6""",
)
def daily_top3(spark, sf):
    _, today = _two_days(spark, sf)
    return today.select(
        "topic_id",
        "article_id",
        "score",
        "position",
        F.col("delivery_date").cast("string").alias("delivery_date"),
    )


@query(
    "short_topics",
    f"""WITH {_KEYWORDS}, {_SCORED}
        SELECT item_id AS topic_id, count(r) AS n_picks
        FROM benchmark LEFT JOIN ranked ON topic_id = item_id AND r <= 3
        GROUP BY item_id HAVING count(r) < 3
        UNION ALL SELECT item_id + 1000000, 0 FROM benchmark""",
)
def short_topics(spark, sf):
    """Each topic has a twin that no article is about."""
    yesterday, _ = _two_days(spark, sf)
    topics = I.topics(spark, sf)
    twins = topics.withColumn("topic_id", F.col("topic_id") + 1000000)
    return deliveries.short_topics(yesterday, topics.unionByName(twins)).withColumn(
        "n_picks", F.col("n_picks").cast("long")
    )


_RATING = "CASE WHEN event_type IN ('click', 'purchase') THEN 'up' ELSE 'down' END"


@query(
    "latest_feedback",
    f"""SELECT user_id, (props->>'$.k')::BIGINT AS article_id, event_id, {_RATING} AS rating
        FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, props->>'$.k'
                                   ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_feedback(spark, sf):
    """Events as ratings; a user rating an article again replaces the rating."""
    rated = I.table(spark, sf, "events").select(
        F.concat_ws("|", "user_id", F.get_json_object("props", "$.k")).alias("delivery"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("article_id"),
        "event_id",
        "ts",
        F.when(F.col("event_type").isin("click", "purchase"), "up").otherwise("down").alias("rating"),
    )
    return deliveries.latest_feedback(rated, "delivery", ["ts", "event_id"]).select(
        "user_id", "article_id", "event_id", "rating"
    )


@query(
    "keyword_weights",
    f"""WITH votes AS (
          SELECT lang AS topic_id, term, count(*) FILTER (quality = 1) AS ups,
                 count(*) FILTER (quality = 0) AS downs
          FROM (SELECT lang, quality, unnest(list_distinct({S.words('text')})) AS term
                FROM documents JOIN labels USING (doc_id))
          WHERE term NOT IN ({S.STOP_LIST}) GROUP BY ALL),
        old AS (
          SELECT DISTINCT 'en' AS topic_id, unnest({S.words('text')}) AS term, 4.8::DOUBLE AS weight
          FROM benchmark)
        SELECT coalesce(votes.topic_id, old.topic_id) AS topic_id,
               coalesce(votes.term, old.term) AS term,
               coalesce(ups, 0)::BIGINT AS ups, coalesce(downs, 0)::BIGINT AS downs,
               round(least(greatest(coalesce(weight, 1.0) * (1 + 0.1::DOUBLE
                 * coalesce((ups - downs) / (ups + downs), 0)), 0.1), 5.0), 6)::DOUBLE AS weight
        FROM votes FULL JOIN old ON votes.topic_id = old.topic_id AND votes.term = old.term""",
)
def keyword_weights(spark, sf):
    """Ratings move the words of rated documents; language is the topic."""
    rated = I.ratings(spark, sf).select(
        F.col("lang").alias("topic_id"),
        "up",
        without_stop_words(words(F.col("text"))).alias("terms"),
    )
    old = (
        I.table(spark, sf, "benchmark")
        .select(F.lit("en").alias("topic_id"), F.explode(words(F.col("text"))).alias("term"))
        .distinct()
        .withColumn("weight", F.lit(4.8))
    )
    moved = deliveries.keyword_weights(rated, old)
    return moved.select(
        "topic_id",
        "term",
        F.col("ups").cast("long").alias("ups"),
        F.col("downs").cast("long").alias("downs"),
        F.round("weight", 6).alias("weight"),
    )


@query(
    "source_performance",
    """SELECT lang AS topic_id, source AS source_id, count(*) AS n_ratings,
              count(*) FILTER (quality = 1) AS ups,
              round((count(*) FILTER (quality = 1) + 1.0) / (count(*) + 2.0), 6)::DOUBLE
                AS performance
       FROM documents JOIN labels USING (doc_id) GROUP BY ALL""",
)
def source_performance(spark, sf):
    rated = I.ratings(spark, sf).select(
        F.col("lang").alias("topic_id"), F.col("source").alias("source_id"), "up"
    )
    return deliveries.source_performance(rated).withColumn(
        "performance", F.round("performance", 6)
    )
