"""Queries over summaries, near duplicates and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions.tokens import each, words
from feedlake.operators import insights, summaries
from feedlake.plans import inputs as I
from feedlake.plans import sqltext as S
from feedlake.plans.registry import query
from feedlake.session import scratch_path
from feedlake.sinks.shingles import ShingleIndex


@query(
    "needs_summary",
    """SELECT doc_id AS article_id, 'default' AS model FROM documents
       WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def needs_summary(spark, sf):
    """Labelled documents are summarised: good ones by the default model."""
    done = I.table(spark, sf, "labels").select(
        F.col("doc_id").alias("article_id"),
        F.when(F.col("quality") == 1, F.lit("default")).otherwise(F.lit("other")).alias("model"),
    )
    candidates = I.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"))
    return summaries.needs_summary(candidates, done, C.SummarySettings().model)


@query(
    "summary_quality",
    rf"""WITH parts AS (
          SELECT conv_id, turn, text,
                 list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'),
                                            lambda s: {S.trim_space('s')}),
                             lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]')) AS s
          FROM conversations)
        SELECT conv_id, turn, len(s)::INT AS n_sentences,
               CASE WHEN len(s) > 3 THEN 'truncated' WHEN len(s) >= 2 THEN 'valid'
                    ELSE 'too_short' END AS status,
               sha256(CASE WHEN len(s) > 3 THEN array_to_string(s[1:3], ' ') ELSE text END)
                 AS stored_sha
        FROM parts""",
)
def summary_quality(spark, sf):
    checked = summaries.check_summaries(I.table(spark, sf, "conversations"), "text")
    return checked.select(
        "conv_id", "turn", "n_sentences", "status", F.sha2("stored_text", 256).alias("stored_sha")
    )


@query(
    "token_budget",
    f"""WITH requests AS (
          SELECT conv_id, conv_id // 100 AS day, sum(len({S.words('text')}))::BIGINT AS tokens
          FROM conversations GROUP BY conv_id)
        SELECT conv_id, day, tokens, spent, spent <= 5000 AS within_budget
        FROM (SELECT *, sum(tokens) OVER (PARTITION BY day ORDER BY conv_id)::BIGINT AS spent
              FROM requests)""",
)
def token_budget(spark, sf):
    """Conversations as requests of a hundred per day, in order of their id."""
    requests = (
        I.table(spark, sf, "conversations")
        .select("conv_id", F.size(words(F.col("text"))).cast("long").alias("tokens"))
        .groupBy("conv_id")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("day", F.expr("conv_id div 100"))
    )
    return summaries.token_budget(requests, "day", "conv_id", "tokens", budget=5000).select(
        "conv_id", "day", "tokens", "spent", "within_budget"
    )


def _near_duplicates_sql() -> str:
    """All pairs that share a shingle, measured; no prefixes and no leaders."""
    settings = C.NearDuplicateSettings()
    n = settings.shingle_words
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH tokenised AS (SELECT doc_id, {S.words('text')} AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= {n}
      THEN list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})
      ELSE [array_to_string(w, ' ')] END) AS g
  FROM tokenised),
shingles AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5(g), 1, 12))::BIGINT % 2147483647 AS h FROM grams),
sizes AS (SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id, b.doc_id AS other, count(*) AS c
  FROM shingles a JOIN shingles b ON a.h = b.h AND b.doc_id < a.doc_id GROUP BY ALL),
checked AS (
  SELECT c.doc_id, other, round(c / (x.size + y.size - c), 6) AS jaccard
  FROM common c JOIN sizes x USING (doc_id) JOIN sizes y ON y.doc_id = other
  WHERE c * 100 >= (x.size + y.size - c) * {settings.percent})
SELECT doc_id, other AS duplicate_of, jaccard FROM checked
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, other) = 1"""


@query("near_duplicates", _near_duplicates_sql())
def near_duplicates(spark, sf):
    return insights.near_duplicates(I.documents_table(spark, sf).select("doc_id", "text"))


@query("near_duplicates_history", _near_duplicates_sql())
def near_duplicates_history(spark, sf):
    """The older half of the documents is stored first, then the newer half meets it."""
    docs = I.documents_table(spark, sf).select("doc_id", "text")
    middle = docs.select((F.min("doc_id") + F.max("doc_id")) / 2).scalar()
    index = ShingleIndex(spark, scratch_path(spark, "shingles"))
    older = index.add(docs.where(F.col("doc_id") <= middle), "0000")
    return older.unionByName(index.add(docs.where(F.col("doc_id") > middle), "0001"))


@query(
    "adjacent_topics",
    """WITH likes AS (SELECT DISTINCT user_id, props->>'$.k' AS topic FROM events),
       sizes AS (SELECT topic, count(*) AS users FROM likes GROUP BY topic),
       n AS (SELECT count(DISTINCT user_id) AS n_users FROM likes)
       SELECT a.topic AS topic_a, b.topic AS topic_b, count(*) AS shared_users,
              round(count(*) * any_value(n_users) / any_value(sa.users * sb.users), 6) AS lift
       FROM likes a JOIN likes b ON a.user_id = b.user_id AND a.topic < b.topic
       JOIN sizes sa ON sa.topic = a.topic JOIN sizes sb ON sb.topic = b.topic, n
       GROUP BY ALL""",
)
def adjacent_topics(spark, sf):
    """The number in an event's properties is its topic."""
    interests = I.table(spark, sf, "events").select(
        "user_id", F.get_json_object("props", "$.k").alias("topic")
    )
    return insights.adjacent_topics(interests).withColumn("lift", F.round("lift", 6))


@query(
    "neighbouring_topics",
    f"""WITH likes AS (SELECT DISTINCT user_id, props->>'$.k' AS topic FROM events WHERE event_type = 'purchase'),
       used AS (SELECT DISTINCT (doc_id % 130)::VARCHAR AS topic, unnest({S.words("string_split(text, chr(10))[1]")}) AS term
                FROM documents),
       n AS (SELECT count(DISTINCT topic) AS n FROM used),
       weighed AS (SELECT term, ln(any_value(n.n)::DOUBLE / count(*)) AS w FROM used, n GROUP BY term),
       terms AS (SELECT topic, term, w FROM used JOIN weighed USING (term) WHERE w > 0),
       sized AS (SELECT topic, count(*) AS users FROM likes GROUP BY topic),
       normed AS (SELECT topic, sum(w * w) AS norm FROM terms GROUP BY topic),
       by_user AS (SELECT a.topic AS topic_a, b.topic AS topic_b, count(*) AS shared_users,
                          round(count(*) / sqrt(any_value(sa.users * sb.users)), 6) AS user_score
                   FROM likes a JOIN likes b ON a.user_id = b.user_id AND a.topic <> b.topic
                   JOIN sized sa ON sa.topic = a.topic JOIN sized sb ON sb.topic = b.topic
                   GROUP BY ALL HAVING count(*) >= 2),
       by_term AS (SELECT a.topic AS topic_a, b.topic AS topic_b, count(*) AS shared_terms,
                          round(sum(a.w * a.w) / sqrt(any_value(na.norm * nb.norm)), 6) AS term_score
                   FROM terms a JOIN terms b ON a.term = b.term AND a.topic <> b.topic
                   JOIN normed na ON na.topic = a.topic JOIN normed nb ON nb.topic = b.topic
                   GROUP BY ALL HAVING count(*) >= 2),
       pairs AS (SELECT topic_a AS topic, topic_b AS neighbour, coalesce(shared_users, 0) AS shared_users,
                        coalesce(shared_terms, 0) AS shared_terms, coalesce(user_score, 0) AS user_score,
                        coalesce(term_score, 0) AS term_score
                 FROM by_user FULL JOIN by_term USING (topic_a, topic_b))
       SELECT *, round(0.5 * user_score + 0.5 * term_score, 8) AS score,
              row_number() OVER (PARTITION BY topic
                ORDER BY round(0.5 * user_score + 0.5 * term_score, 8) DESC, neighbour)::INTEGER AS rank
       FROM pairs QUALIFY rank <= 10""",
)
def neighbouring_topics(spark, sf):
    """Numbers of events' properties are topics, liked by who purchased; documents belong
    to topics by their id, and their first lines give the terms. Thirty have no event."""
    interests = I.table(spark, sf, "events").where("event_type = 'purchase'").select(
        "user_id", F.get_json_object("props", "$.k").alias("topic")
    )
    title = F.substring_index("text", "\n", 1)
    terms = I.documents_table(spark, sf).select(
        (F.col("doc_id") % 130).cast("string").alias("topic"), each(words(title)).alias("term")
    )
    return insights.neighbouring_topics(interests, terms)


def _activity(spark, sf):
    kind = F.col("event_type")
    return I.table(spark, sf, "events").select(
        "ts",
        "user_id",
        kind.alias("topic"),
        F.get_json_object("props", "$.k").alias("article_id"),
        (kind == "view").alias("is_view"),
        kind.isin("click", "purchase").alias("is_interaction"),
    )


@query(
    "kpi_daily",
    """WITH per AS (
         SELECT ts::DATE AS day, user_id, count(*) AS n, count(DISTINCT event_type) AS topics,
                count(DISTINCT props->>'$.k') AS articles,
                count(*) FILTER (event_type = 'view') AS views,
                count(*) FILTER (event_type IN ('click', 'purchase')) AS interactions
         FROM events GROUP BY ALL)
       SELECT day::VARCHAR AS day, count(*) AS active_users, sum(n)::BIGINT AS events,
              round(sum(topics) / count(*), 6) AS topics_per_user,
              round(sum(interactions) / nullif(sum(views), 0), 6) AS interaction_rate,
              round(1 - sum(articles) / sum(n), 6) AS repeat_rate
       FROM per GROUP BY day""",
)
def kpi_daily(spark, sf):
    rates = ("topics_per_user", "interaction_rate", "repeat_rate")
    return (
        insights.kpi_daily(_activity(spark, sf))
        .withColumns({c: F.round(c, 6) for c in rates})
        .withColumn("day", F.col("day").cast("string"))
    )


@query(
    "source_diversity",
    """WITH per AS (SELECT ts::DATE AS day, props->>'$.k' AS k, count(*) AS n FROM events GROUP BY ALL)
       SELECT day::VARCHAR AS day, count(*) AS sources, round(max(n) / sum(n), 6) AS top_source_share
       FROM per GROUP BY day""",
)
def source_diversity(spark, sf):
    return (
        insights.source_diversity(_activity(spark, sf), "article_id")
        .withColumn("top_source_share", F.round("top_source_share", 6))
        .withColumn("day", F.col("day").cast("string"))
    )


@query(
    "time_to_delivery",
    """SELECT o_orderpriority AS topic, count(*) AS n,
              round(quantile_cont(delay, 0.5) / 3600000000.0, 6) AS p50_hours,
              round(quantile_cont(delay, 0.95) / 3600000000.0, 6) AS p95_hours
       FROM (SELECT o_orderpriority, (epoch_us(l_shipdate) - epoch_us(o_orderdate)
                + (l_orderkey * 7919 + l_linenumber * 13) % 86400 * 1000000)::DOUBLE AS delay
             FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY ALL""",
)
def time_to_delivery(spark, sf):
    """Order date to ship date and a time of that day, by priority."""
    orders = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_orderpriority").alias("topic"),
        F.col("o_orderdate").alias("published_at"),
    )
    delivered = (
        I.table(spark, sf, "lineitem")
        .select(
            "l_orderkey",
            F.timestamp_add(
                "SECOND", (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 13) % 86400, "l_shipdate"
            ).alias("delivered_at"),
        )
        .join(orders, "l_orderkey")
    )
    timed = insights.time_to_delivery(delivered, "topic")
    return timed.withColumns({c: F.round(c, 6) for c in ("p50_hours", "p95_hours")})


@query(
    "interest_drift",
    """WITH counted AS (
         SELECT time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS w, event_type AS topic,
                count(*) AS n
         FROM events GROUP BY ALL),
       shares AS (SELECT *, n / sum(n) OVER (PARTITION BY w) AS share FROM counted)
       SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, topic, n,
              round(share, 6) AS share,
              round(share - lag(share) OVER (PARTITION BY topic ORDER BY w), 6) AS drift
       FROM shares""",
)
def interest_drift(spark, sf):
    interests = I.table(spark, sf, "events").select("ts", F.col("event_type").alias("topic"))
    return insights.interest_drift(interests).select(
        I.text_stamp("window_start"),
        "topic",
        "n",
        F.round("share", 6).alias("share"),
        F.round("drift", 6).alias("drift"),
    )


@query(
    "stream_freshness",
    """SELECT strftime(time_bucket(INTERVAL 5 MINUTES, ts, TIMESTAMP '1970-01-01'),
                       '%Y-%m-%d %H:%M:%S') AS window_start,
              count(*) AS n, count(*) FILTER (value < 5) AS n_fresh, max(value) AS max_lag
       FROM events GROUP BY ALL""",
)
def stream_freshness(spark, sf):
    """The batch form of the streaming job: an event's value is its lag in minutes."""
    arrivals = I.table(spark, sf, "events").select("ts", F.col("value").alias("lag_minutes"))
    return insights.freshness(arrivals).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    )
