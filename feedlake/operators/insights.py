"""Corpus and usage insights: near duplicates, adjacent topics, KPIs, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions.text import let
from feedlake.functions.tokens import ngrams, words
from feedlake.operators import likeness
from feedlake.session import materialize

_PRIME = 2**31 - 1


def shingles(text: Column, n: int) -> Column:
    """Word n-grams; a text of fewer words counts as one."""
    return let(
        words(text),
        lambda w: F.when(F.size(w) >= n, ngrams(w, n)).otherwise(F.array(F.array_join(w, " "))),
    )


def shingle_hash(gram: Column) -> Column:
    """31-bit hash of a shingle, the same on every engine that has MD5."""
    return F.conv(F.substring(F.md5(gram), 1, 12), 16, 10).cast("long") % _PRIME


def shingle_set(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(shingles(text, n), shingle_hash))


def rarest_first(shingles: str, shared: str) -> Column:
    """The sorted shingles of a document, those of ``shared``, structs (f, h) in order, last;
    a null list has none."""
    behind = F.coalesce(F.transform(shared, lambda x: x["h"]), F.array().cast("array<bigint>"))
    return F.concat(F.array_except(shingles, behind), behind)


def near_duplicates(
    docs: DataFrame, settings: C.NearDuplicateSettings = C.NearDuplicateSettings()
) -> DataFrame:
    """(doc_id, duplicate_of, jaccard): the most similar earlier document.

    ``docs``: doc_id, text. Every pair of shingle sets at the threshold is found: such
    sets share one of their rarest shingles (prefix filter), early enough in that order
    (positional filter), and differ little in size; the pairs left are verified. Equal
    sets meet once, through their first document, so a crowd of copies costs its rows
    and no pairs. Ties go to the smallest id.
    """
    percent = settings.percent
    sets = docs.select(
        "doc_id", F.array_sort(shingle_set(F.col("text"), settings.shingle_words)).cast("array<int>").alias("s")
    ).select("doc_id", F.xxhash64("s").alias("key"), F.size("s").alias("n"), "s")
    sets = materialize(sets, "sets")
    leaders = materialize(sets.groupBy("key", "n").agg(F.min("doc_id").alias("leader")), "leaders")
    others = sets.select("doc_id").distinct().join(leaders.select(F.col("leader").alias("doc_id")), "doc_id", "left_anti")

    # Sets stay where they are: prefixes leave them, and of these the copies are taken.
    prefixes = likeness.rarest(sets.filter("doc_id is not null"), likeness.counted(sets), percent)
    prefixes = prefixes.join(materialize(others, "others"), "doc_id", "left_anti")
    found = materialize(likeness.met(prefixes, percent).distinct(), "pairs")
    found = materialize(likeness.sifted(sets, found, percent), "alike")
    measured = likeness.likest(sets, found, percent).withColumnRenamed("other", "duplicate_of")
    similar = measured.select(
        "doc_id",
        "duplicate_of",
        F.round(F.col("common") / (F.col("total") - F.col("common")), 6).alias("jaccard"),
    )
    best = Window.partitionBy("doc_id").orderBy(F.desc("jaccard"), "duplicate_of")
    similar = similar.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")
    copies = (
        sets.join(leaders, ["key", "n"])
        .filter(F.col("doc_id") != F.col("leader"))
        .select("doc_id", F.col("leader").alias("duplicate_of"), F.lit(1.0).alias("jaccard"))
    )
    return similar.unionByName(copies)


def adjacent_topics(interests: DataFrame) -> DataFrame:
    """Lift of two topics sharing users: p(ab) / (p(a) p(b)).

    ``interests``: user_id, topic. Repeats collapse before anything is paired;
    the pairs of one user come from the set of topics, whose size the topic
    catalogue bounds, never from the user's rows.
    """
    per_user = interests.groupBy("user_id").agg(F.array_sort(F.collect_set("topic")).alias("ts"))
    n_users = per_user.agg(F.count(F.lit(1))).scalar()
    sizes = (
        per_user.select(F.explode("ts").alias("topic"))
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("users"))
    )
    pairs = (
        per_user.select("ts", F.posexplode("ts").alias("i", "topic_a"))
        .select("topic_a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("topic_b"))
        .groupBy("topic_a", "topic_b")
        .agg(F.count(F.lit(1)).alias("shared_users"))
    )
    return (
        pairs.join(sizes.select(F.col("topic").alias("topic_a"), F.col("users").alias("ua")), "topic_a")
        .join(sizes.select(F.col("topic").alias("topic_b"), F.col("users").alias("ub")), "topic_b")
        .select(
            "topic_a",
            "topic_b",
            "shared_users",
            (F.col("shared_users") * n_users / (F.col("ua") * F.col("ub"))).alias("lift"),
        )
    )


def _weighted_pairs(rows: DataFrame, key: str) -> DataFrame:
    """(topic_a, topic_b, shared, product): topics that meet in a key (a user or a term),
    how often, and the sum of the keys' squared weights. ``rows``: key, topic, weight;
    distinct. Sums form on the map side, so a key that many topics share costs its
    pairs in one task's memory only as far as they differ."""
    a = rows.select(key, F.col("topic").alias("topic_a"), "weight")
    b = rows.select(key, F.col("topic").alias("topic_b"))
    met = a.join(b, key).where(F.col("topic_a") < F.col("topic_b"))
    return met.groupBy("topic_a", "topic_b").agg(
        F.count(F.lit(1)).alias("shared"), F.sum(F.col("weight") * F.col("weight")).alias("product")
    )


def _cosines(rows: DataFrame, key: str, least: int, shared: str, score: str) -> DataFrame:
    """Cosine of two topics' weighted key sets, for pairs that share ``least`` keys."""
    norms = rows.groupBy("topic").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"))
    pairs = _weighted_pairs(rows, key).where(F.col("shared") >= least)
    pairs = pairs.join(norms.select(F.col("topic").alias("topic_a"), F.col("norm").alias("na")), "topic_a")
    pairs = pairs.join(norms.select(F.col("topic").alias("topic_b"), F.col("norm").alias("nb")), "topic_b")
    cosine = F.round(F.col("product") / F.sqrt(F.col("na") * F.col("nb")), 6)
    return pairs.select("topic_a", "topic_b", F.col("shared").alias(shared), cosine.alias(score))


def neighbouring_topics(
    interests: DataFrame, terms: DataFrame, settings: C.AdjacencySettings = C.AdjacencySettings()
) -> DataFrame:
    """(topic, neighbour, shared_users, shared_terms, user_score, term_score, score, rank):
    the ``k`` topics next to each, by users and by terms in common.

    ``interests``: user_id, topic; ``terms``: topic, term; repeats count once. Users weigh
    the same; a term weighs ln(topics / topics that have it), so one that all topics have
    adds nothing and is left out before anything is paired. Both scores are cosines of
    weighted sets; a pair with less than the minimum support in users or terms has no
    score of that kind, and one without either is no neighbour. Topics that share terms
    but no user are found, and the other way round. Ties go to the smaller topic.
    """
    liked = interests.where("user_id is not null and topic is not null").select("user_id", "topic").distinct()
    by_user = _cosines(liked.withColumn("weight", F.lit(1.0)), "user_id", settings.min_users, "shared_users", "user_score")

    used = materialize(terms.where("topic is not null and term is not null").select("topic", "term").distinct(), "terms")
    n_topics = used.agg(F.count_distinct("topic")).scalar()
    weighed = used.groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("n_topics", n_topics)
    # A term of one topic meets no other, but belongs to that topic's norm. One join gives all
    # weights: a union of joined rows may keep its parts apart, which the joins behind do not expect.
    weighed = weighed.where("n < n_topics").select("term", F.log(F.col("n_topics") / F.col("n")).alias("weight"))
    rows = materialize(used.join(weighed, "term").select("topic", "term", "weight"), "weights")
    by_term = _cosines(rows, "term", settings.min_terms, "shared_terms", "term_score")

    pairs = by_user.join(by_term, ["topic_a", "topic_b"], "full_outer").na.fill(0)
    score = F.round(
        (1 - settings.term_weight) * F.col("user_score") + settings.term_weight * F.col("term_score"), 8
    )
    pairs = pairs.withColumn("score", score)
    measures = ("shared_users", "shared_terms", "user_score", "term_score", "score")
    ways = F.array(
        F.struct(F.col("topic_a").alias("topic"), F.col("topic_b").alias("neighbour")),
        F.struct(F.col("topic_b").alias("topic"), F.col("topic_a").alias("neighbour")),
    )
    both = pairs.select(F.explode(ways).alias("t"), *measures).select("t.topic", "t.neighbour", *measures)
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "neighbour")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k)


def kpi_daily(activity: DataFrame) -> DataFrame:
    """Usage per day.

    ``activity``: ts, user_id, topic, article_id, is_view, is_interaction. Events
    fold to one row per (day, user, topic, article) first, whatever a single user
    or day adds.
    """
    day = F.to_date("ts").alias("day")
    base = activity.groupBy(day, "user_id", "topic", "article_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_view").alias("views"),
        F.count_if("is_interaction").alias("interactions"),
    )
    per_user = base.groupBy("day", "user_id").agg(
        F.countDistinct("topic").alias("topics"),
        F.countDistinct("article_id").alias("articles"),
        *[F.sum(c).alias(c) for c in ("n", "views", "interactions")],
    )
    users, total = F.count(F.lit(1)), F.sum("n")
    return per_user.groupBy("day").agg(
        users.alias("active_users"),
        total.alias("events"),
        (F.sum("topics") / users).alias("topics_per_user"),
        (F.sum("interactions") / F.nullif(F.sum("views"), F.lit(0))).alias("interaction_rate"),
        (1 - F.sum("articles") / total).alias("repeat_rate"),
    )


def source_diversity(activity: DataFrame, source: str) -> DataFrame:
    """Distinct sources per day and the largest source's share of the day."""
    per_source = activity.groupBy(F.to_date("ts").alias("day"), source).agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_source.groupBy("day").agg(
        F.count(F.lit(1)).alias("sources"),
        (F.max("n") / F.sum("n")).alias("top_source_share"),
    )


def time_to_delivery(deliveries: DataFrame, *by: str | Column) -> DataFrame:
    """Median and 95th percentile of delivered_at - published_at in hours, exact.

    No task holds all delays of a key. Deliveries are counted in spans of 2**32
    microseconds, then in pieces of 2**16 of the spans that hold a wanted place, then by
    single delays of those pieces. Delays are written out once and read for each of these.
    """
    micros = F.unix_micros(F.col("delivered_at").cast("timestamp")) - F.unix_micros(
        F.col("published_at").cast("timestamp")
    )
    rows = materialize(deliveries.select(*by, micros.alias("delay")), "delays")
    keys = rows.columns[:-1]
    totals = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("delay").alias("known")), "totals")
    shares = F.explode(F.array(F.lit(0.5), F.lit(0.95))).alias("p")
    wanted = totals.where("known > 0").select(*keys, shares, "known").withColumn("place", F.expr("(known - 1) * p"))
    ends = F.posexplode(F.array(F.floor("place"), F.ceil("place"))).alias("end", "rest")
    wanted = wanted.select(*keys, "p", "place", ends).withColumn("span", F.lit(0).cast("long"))
    for outer, inner in ((64, 32), (32, 16), (16, 0)):
        span = F.lit(0).cast("long") if outer == 64 else F.shiftright("delay", outer)
        parts = rows.where("delay is not null").select(*keys, span.alias("span"), F.shiftright("delay", inner).alias("part"))
        if outer < 64:
            parts = _null_safe(parts, wanted.select(*keys, "span").distinct(), [*keys, "span"], "left_semi")
        counts = parts.groupBy(*keys, "span", "part").agg(F.count(F.lit(1)).alias("n"))
        # A window has 2**16 rows at most, on the first level one for each span in use.
        upto = F.sum("n").over(Window.partitionBy(*keys, "span").orderBy("part"))
        counts = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        met = _null_safe(wanted, counts, [*keys, "span"], "inner").where("before <= rest and rest < upto")
        wanted = met.select(*keys, "p", "place", "end", (F.col("rest") - F.col("before")).alias("rest"), F.col("part").alias("span"))
        wanted = materialize(wanted, "places")
    delay = F.col("span").cast("double")
    found = wanted.groupBy(*keys, "p", "place").agg(
        F.max(F.when(F.col("end") == 0, delay)).alias("lower"), F.max(F.when(F.col("end") == 1, delay)).alias("upper")
    )
    between = (F.ceil("place") - F.col("place")) * F.col("lower") + (F.col("place") - F.floor("place")) * F.col("upper")
    hours = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(between) / 3_600_000_000
    timed = found.groupBy(*keys).agg(
        F.max(F.when(F.col("p") == 0.5, hours)).alias("p50_hours"), F.max(F.when(F.col("p") == 0.95, hours)).alias("p95_hours")
    )
    return _null_safe(totals.drop("known"), timed, keys, "left")


def _null_safe(rows: DataFrame, others: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys are equal; ``keys`` come once, from ``rows``."""
    named = others.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(named, same, how).drop(*(f"_{k}" for k in keys))


def interest_drift(interests: DataFrame, width: str = "7 days") -> DataFrame:
    """Share of each topic per time window and its change from the window before.

    ``interests``: ts, topic. The windows run over aggregated rows.
    """
    counted = (
        interests.groupBy(F.window("ts", width).alias("w"), "topic")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "topic", "n")
    )
    shares = counted.withColumn(
        "share", F.col("n") / F.sum("n").over(Window.partitionBy("window_start"))
    )
    previous = F.lag("share").over(Window.partitionBy("topic").orderBy("window_start"))
    return shares.withColumn("drift", F.col("share") - previous)


def freshness(arrivals: DataFrame, width: str = "5 minutes", limit_minutes: float = 5.0) -> DataFrame:
    """Articles per tumbling window and how many arrived in time.

    ``arrivals``: ts, lag_minutes. The same expression runs on a stream (see
    :mod:`feedlake.streaming.freshness`).
    """
    return (
        arrivals.groupBy(F.window("ts", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("lag_minutes") < limit_minutes).alias("n_fresh"),
            F.max("lag_minutes").alias("max_lag"),
        )
        .select(F.col("w.start").alias("window_start"), "n", "n_fresh", "max_lag")
    )
