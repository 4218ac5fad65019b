"""Queries over scans, loads, the catalogue and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions import urls
from feedlake.operators import catalog, dedup, entries, validation
from feedlake.plans import inputs as I
from feedlake.plans import sqltext as S
from feedlake.plans.registry import query
from feedlake.session import materialize, scratch_path
from feedlake.sources import decode, feeds, tables
from feedlake.streaming.health import current_health, follow_health
from feedlake.streaming.ingest import stream_ingest as start_stream

# --- Scans ------------------------------------------------------------------


def _landed_feeds(spark, sf):
    """Pages written as RSS item files to the shared folder."""
    path = scratch_path(spark, "landing")
    items = I.page_entries(spark, sf).select(
        "title",
        "link",
        F.col("summary").alias("description"),
        F.lit("desk & co").alias("author"),
        F.col("published").alias("pubDate"),
        F.col("tags").alias("category"),
    )
    feeds.write_rss(items, path)
    return path


@query(
    "scan_feed_items",
    f"""WITH {S.PAGE_ENTRIES}
        SELECT trim(title) AS title, link, sha256(trim(summary)) AS description_sha,
               'desk & co' AS author, len(tags)::INT AS n_tags,
               published_at IS NOT NULL AS dated
        FROM page_entries""",
)
def scan_feed_items(spark, sf):
    found = feeds.read_entries(spark, _landed_feeds(spark, sf))
    return found.select(
        F.trim("title").alias("title"),
        "link",
        F.sha2(F.trim("description"), 256).alias("description_sha"),
        "author",
        F.coalesce(F.size("tags"), F.lit(0)).alias("n_tags"),
        F.col("published").isNotNull().alias("dated"),
    )


@query(
    "scan_corrupt_feed",
    """SELECT page_id, CASE WHEN url LIKE '%?%' THEN NULL ELSE url END AS link,
              url LIKE '%?%' AS parse_error
       FROM pages""",
)
def scan_corrupt_feed(spark, sf):
    """One RSS item per page; payloads of addresses with a query arrive cut short."""
    link = F.concat(F.lit("<link>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")))
    damaged = F.col("url").contains("?")
    ending = F.when(damaged, F.lit("</lin")).otherwise(F.lit("</link></item>"))
    payloads = I.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("<item><title>t</title>"), link, ending).alias("payload")
    )
    parsed = feeds.parse_items(payloads, "payload")
    return parsed.select("page_id", F.col("item.link").alias("link"), "parse_error")


#: Items of under a hundred bytes each.
CHANNEL_ITEMS = 20_000


def _landed_channels(spark, sf):
    """A folder of RSS files per host, CHANNEL_ITEMS items or so in each; a page cut before
    its end is a cut item."""
    path = scratch_path(spark, "channels")
    host = urls.url_host(F.col("url"))
    title = F.when(host.startswith("www."), F.lit("")).otherwise(
        F.concat(F.lit("<title>Feed of "), host, F.lit(" &amp; co</title>"))
    )
    item = F.concat(
        F.lit("<item><title>p"), F.col("page_id").cast("string"),
        F.when(F.col("html").contains("</html>"), F.lit("</title></item>")).otherwise(F.lit("</ti")),
    )
    per_host = I.table(spark, sf, "pages").select(host.alias("host"), title.alias("title"), item.alias("item"))
    files_of = per_host.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / CHANNEL_ITEMS).alias("files"))
    dealt = per_host.join(files_of, "host").withColumn("file", F.pmod(F.xxhash64("item"), F.col("files")))
    whole = dealt.groupBy("host", "title", "file").agg(F.array_join(F.collect_list("item"), "\n").alias("items"))
    text = F.concat(
        F.lit("<rss><channel>"), F.col("title"), F.lit("<link>https://"), F.col("host"), F.lit("</link>"),
        F.col("items"), F.lit("</channel></rss>"),
    )
    files = whole.select(F.concat(F.lit("host-"), "host").alias("folder"), text.alias("value"))
    files.write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
    return path


@query(
    "feed_metadata",
    f"""SELECT {S.host('url')} AS host,
               CASE WHEN {S.host('url')} LIKE 'www.%' THEN 'Unknown Feed'
                    ELSE 'Feed of ' || {S.host('url')} || ' & co' END AS title,
               'https://' || {S.host('url')} AS link, '' AS description,
               count(*) FILTER (html LIKE '%</html>%') AS entry_count,
               CASE WHEN count(*) FILTER (html NOT LIKE '%</html>%') > 0
                    THEN count(*) FILTER (html NOT LIKE '%</html>%') || ' damaged entries'
                    ELSE '' END AS parsing_errors
        FROM pages GROUP BY ALL""",
)
def feed_metadata(spark, sf):
    """Hosts as feeds, landed as files and read back."""
    host = F.regexp_extract("feed_path", r"folder=host-([^/]+)/", 1)
    found = feeds.feed_metadata(spark, _landed_channels(spark, sf), feed=host)
    return found.select(
        F.col("feed_path").alias("host"),
        "title", "link", "description", "entry_count",
        F.array_join("parsing_errors", "; ").alias("parsing_errors"),
    )


@query(
    "scan_source_list",
    """SELECT s_name AS name, 'https://src' || s_suppkey || '.example.com' AS url,
              'https://src' || s_suppkey || '.example.com/feed' AS feed_url,
              round((s_acctbal + 1000) / 11000, 4) AS credibility_score, s_acctbal >= 0 AS is_active
       FROM supplier""",
)
def scan_source_list(spark, sf):
    seeds = I.credibility_sources(spark, sf).withColumn("seed_order", F.col("id"))
    path = scratch_path(spark, "source-list")
    tables.write_source_list(seeds, path)
    return tables.read_source_list(spark, path)


@query(
    "payload_size_guard",
    """SELECT page_id, octet_length(encode(html))::INT AS length, octet_length(encode(html)) <= 2000 AS size_ok
       FROM pages""",
)
def payload_size_guard(spark, sf):
    """A limit that the longer pages exceed."""
    payloads = I.table(spark, sf, "pages").select("page_id", F.octet_length("html").alias("length"))
    return feeds.payload_size_guard(payloads, limit=2000)


@query(
    "charset_audit",
    r"""WITH kinds AS (
          SELECT text, lang, regexp_matches(text, '[^\x00-\x7f]') AS wide,
                 regexp_matches(text, '[^\x00-\xff]') AS beyond
          FROM documents),
        ruled AS (
          SELECT text, CASE
              WHEN lang = 'de' THEN 'utf16_mark'
              WHEN NOT wide AND lang <> 'fr' THEN 'all_ascii'
              WHEN lang = 'es' AND NOT beyond THEN 'latin_bytes'
              WHEN lang = 'fr' AND NOT beyond THEN 'c1_bytes'
              ELSE 'valid_utf8' END AS rule, lang
          FROM kinds)
        SELECT CASE rule WHEN 'utf16_mark' THEN 'utf-16' WHEN 'all_ascii' THEN 'ascii'
                         WHEN 'latin_bytes' THEN 'iso-8859-1' WHEN 'c1_bytes' THEN 'windows-1252'
                         ELSE 'utf-8' END AS charset,
               rule, count(*) AS n_payloads, 0::BIGINT AS n_replaced,
               sum(length(text) + CASE WHEN rule = 'c1_bytes' THEN 2 ELSE 0 END)::BIGINT AS n_chars
        FROM ruled GROUP BY ALL""",
)
def charset_audit(spark, sf):
    """Texts encoded by language: German UTF-16, Spanish ISO-8859-1, French
    windows-1252 (quoted by bytes 0x93 and 0x94), English UTF-8."""
    text, lang = F.col("text"), F.col("lang")
    latin = ~text.rlike(r"[^\x00-\xff]")
    quoted = F.concat(
        F.unhex(F.lit("93")), F.encode(text, "ISO-8859-1"), F.unhex(F.lit("94"))
    )
    content = (
        F.when(lang == "de", F.encode(text, "UTF-16"))
        .when((lang == "es") & latin, F.encode(text, "ISO-8859-1"))
        .when((lang == "fr") & latin, quoted)
        .otherwise(F.encode(text, "UTF-8"))
    )
    payloads = I.documents_table(spark, sf).select("doc_id", content.alias("content"))
    return decode.charset_audit(decode.decode_payloads(payloads))


# --- Loads ------------------------------------------------------------------


@query(
    "dedup_first_wins",
    f"""WITH {S.doc_articles()}
        SELECT doc_id, source, title, content_hash FROM doc_articles
        QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1""",
)
def dedup_first_wins(spark, sf):
    rows = entries.map_articles(I.document_entries(spark, sf), I.run_date())
    return dedup.first_wins(
        rows.select("doc_id", "source", "title", "content_hash"), "content_hash", ["doc_id"]
    )


@query(
    "duplicate_groups",
    f"""WITH {S.doc_articles()}
        SELECT content_hash, count(*) AS copies, min(doc_id) AS first_id,
               count(DISTINCT source) AS sources
        FROM doc_articles GROUP BY content_hash HAVING count(*) > 1""",
)
def duplicate_groups(spark, sf):
    rows = entries.map_articles(I.document_entries(spark, sf), I.run_date())
    return dedup.duplicate_groups(rows, "content_hash", "doc_id", "source")


def _loaded(rows):
    """Articles of hosts that were loaded by an earlier run."""
    return rows.filter(F.col("host").startswith("blog.") | F.col("host").startswith("www."))


_LOADED_SQL = "(host LIKE 'blog.%' OR host LIKE 'www.%')"


@query(
    "incremental_insert",
    f"""WITH {S.page_articles()}
        SELECT page_id, link, content_hash FROM page_articles
        WHERE content_hash NOT IN (SELECT content_hash FROM page_articles WHERE {_LOADED_SQL})
        QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY page_id) = 1""",
)
def incremental_insert(spark, sf):
    """All pages arrive; those of some hosts are in the table already. Cleaned once."""
    rows = entries.map_articles(I.page_entries(spark, sf), I.run_date())
    rows = materialize(rows.select("page_id", "link", "content_hash", "host"), "cleaned")
    batch = rows.select("page_id", "link", "content_hash")
    return dedup.new_articles(batch, _loaded(rows), ["page_id"])


@query(
    "run_counters",
    f"""WITH {S.doc_articles()},
        known AS (SELECT content_hash FROM doc_articles WHERE source_id >= 15),
        tagged AS (
          SELECT source, source_id <= 0 AS bad,
                 content_hash IN (SELECT content_hash FROM known) AS stored,
                 min(doc_id) FILTER (source_id > 0) OVER (PARTITION BY content_hash) = doc_id AS first
          FROM doc_articles)
        SELECT source, count(*) AS parsed,
               count(*) FILTER (NOT bad AND NOT stored AND first) AS inserted,
               count(*) FILTER (NOT bad AND (stored OR NOT first)) AS skipped,
               count(*) FILTER (bad) AS errors
        FROM tagged GROUP BY source""",
)
def run_counters(spark, sf):
    """Counters per source: src0 breaks a rule, sources from 15 on are stored already."""
    rows = entries.map_articles(I.document_entries(spark, sf), I.run_date())
    checked = validation.validate_articles(rows).select(
        "source", "source_id", "feed_order", "content_hash", "violations"
    )
    checked = materialize(checked, "cleaned")
    stored = checked.filter(F.col("source_id") >= 15)
    return dedup.run_counters(checked, stored, "source", "feed_order")


_STREAM_SQL = f"""WITH {S.page_articles()}
    SELECT title, link, count(*)::BIGINT AS copies FROM (
      SELECT DISTINCT ON (content_hash) title, link, content_hash FROM page_articles)
    GROUP BY title, link"""


@query("stream_ingest", _STREAM_SQL)
def stream_ingest(spark, sf):
    """The landing folder followed by a stream until drained, twice."""
    landing, table = _landed_feeds(spark, sf), scratch_path(spark, "articles")
    checkpoint = scratch_path(spark, "checkpoint")
    for _ in range(2):
        stream = start_stream(
            spark, landing, table, checkpoint, F.lit(1).cast("long"), I.run_date(), ("rss",)
        )
        stream.awaitTermination()
    loaded = spark.read.parquet(f"{table}/articles")
    return loaded.groupBy("title", "link").agg(F.count(F.lit(1)).alias("copies"))


# --- Catalogue --------------------------------------------------------------

_STORED_AT = "2023-12-01"


def _stored_sources(spark, sf):
    """The sources of the documents, as an earlier run stored them."""
    number = F.substring_index("source", "src", -1)
    names = I.table(spark, sf, "documents").select("source").distinct()
    return names.select(
        (number.cast("long") + 1).alias("id"),
        F.col("source").alias("name"),
        F.concat(F.lit("https://src"), number, F.lit(".example.com")).alias("url"),
        F.concat(F.lit("https://src"), number, F.lit(".example.com/feed")).alias("feed_url"),
        F.lit(0.5).alias("credibility_score"),
        F.lit(True).alias("is_active"),
        F.lit(None).cast("timestamp").alias("last_fetched_at"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(2).alias("error_count"),
        F.lit(_STORED_AT).cast("timestamp").alias("created_at"),
        F.lit(_STORED_AT).cast("timestamp").alias("updated_at"),
    )


def _seeds(spark, sf):
    """Two seeds per supplier, the second one wins; scores may be missing."""
    sources = I.credibility_sources(spark, sf)
    score = F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("credibility_score"))
    second = sources.select(
        (F.col("id") * 2 + 1).alias("seed_order"),
        "name", "url", "feed_url", score.cast("double").alias("credibility_score"), "is_active",
    )
    first = second.withColumns(
        {"seed_order": F.col("seed_order") - 1, "name": F.lit("old name"), "is_active": F.lit(True)}
    )
    return catalog.last_seed_wins(first.unionByName(second), "seed_order")


_UPSERT_SQL = """
WITH stored AS (
  SELECT DISTINCT replace(source, 'src', '')::BIGINT AS k, source AS name FROM documents),
seeds AS (
  SELECT s_suppkey AS k, s_name AS name, s_acctbal >= 0 AS is_active,
         CASE WHEN s_suppkey % 10 = 0 THEN 0.5::DOUBLE
              ELSE round((s_acctbal + 1000) / 11000, 4) END AS score
  FROM supplier),
merged AS (
  SELECT coalesce(seeds.k, stored.k) AS k, coalesce(seeds.name, stored.name) AS name,
         coalesce(score, 0.5::DOUBLE) AS credibility_score,
         coalesce(is_active, true) AS is_active,
         CASE WHEN stored.k IS NULL THEN 0 ELSE 2 END AS error_count,
         CASE WHEN stored.k IS NULL THEN '2024-01-31 00:00:00' ELSE '2023-12-01 00:00:00' END
           AS created_at,
         CASE WHEN stored.k IS NULL OR seeds.k IS NOT NULL THEN '2024-01-31 00:00:00'
              ELSE '2023-12-01 00:00:00' END AS updated_at,
         CASE WHEN stored.k IS NULL THEN 'created' WHEN seeds.k IS NULL THEN 'untouched'
              ELSE 'updated' END AS action
  FROM stored FULL JOIN seeds ON stored.k = seeds.k)
"""


@query(
    "upsert_sources",
    _UPSERT_SQL
    + """SELECT name, 'https://src' || k || '.example.com' AS url,
                'https://src' || k || '.example.com/feed' AS feed_url, credibility_score,
                is_active, error_count, created_at, updated_at, action
         FROM merged""",
)
def upsert_sources(spark, sf):
    upserted = catalog.upsert_sources(_stored_sources(spark, sf), _seeds(spark, sf), I.run_date())
    return upserted.select(
        "name", "url", "feed_url", "credibility_score", "is_active", "error_count",
        I.text_stamp("created_at"), I.text_stamp("updated_at"), "action",
    )


@query(
    "seed_counters",
    _UPSERT_SQL
    + """SELECT count(*) FILTER (action = 'created') AS created,
                count(*) FILTER (action = 'updated') AS updated, 0::BIGINT AS skipped
         FROM merged""",
)
def seed_counters(spark, sf):
    return catalog.seed_counters(
        catalog.upsert_sources(_stored_sources(spark, sf), _seeds(spark, sf), I.run_date())
    )


@query(
    "placeholder_sources",
    f"""SELECT DISTINCT 'Unknown Source (https://' || {S.host('url')} || '/feed)' AS name,
               'https://' || {S.host('url')} || '/feed' AS url,
               'https://' || {S.host('url')} || '/feed' AS feed_url,
               0.5::DOUBLE AS credibility_score, false AS is_active, 0 AS error_count
        FROM pages WHERE {S.host('url')} NOT LIKE 'blog.%'""",
)
def placeholder_sources(spark, sf):
    """Hosts the catalogue lacks (it knows the blogs)."""
    feed = F.concat(F.lit("https://"), urls.url_host(F.col("url")), F.lit("/feed"))
    wanted = I.table(spark, sf, "pages").select(feed.alias("feed_url"))
    known = wanted.filter(F.col("feed_url").startswith("https://blog."))
    return catalog.placeholder_sources(wanted, known, I.run_date()).select(
        "name", "url", "feed_url", "credibility_score", "is_active", "error_count"
    )


_HEALTH_SQL = """
last_ok AS (
  SELECT user_id, max(ts) FILTER (event_type <> 'error') AS ok_at FROM events GROUP BY user_id),
open_failures AS (
  SELECT e.user_id, count(*) AS n, arg_max(e.props, (e.ts, e.event_id)) AS props
  FROM events e JOIN last_ok l USING (user_id)
  WHERE e.event_type = 'error' AND (l.ok_at IS NULL OR e.ts > l.ok_at)
  GROUP BY e.user_id),
health AS (
  SELECT user_id AS source_id, ok_at, coalesce(n, 0)::BIGINT AS error_count,
         'fetch failed: ' || props AS last_error
  FROM last_ok LEFT JOIN open_failures USING (user_id))
"""


@query(
    "source_health",
    f"""WITH {_HEALTH_SQL}
        SELECT source_id, strftime(ok_at, '%Y-%m-%d %H:%M:%S') AS last_fetched_at, error_count,
               last_error
        FROM health""",
)
def source_health(spark, sf):
    health = catalog.source_health(I.fetch_runs(spark, sf))
    return health.select(
        "source_id", I.text_stamp("last_fetched_at"), "error_count", "last_error"
    )


@query(
    "stream_source_health",
    f"""WITH {_HEALTH_SQL}
        SELECT source_id, strftime(ok_at, '%Y-%m-%d %H:%M:%S') AS last_fetched_at, error_count,
               last_error
        FROM health""",
)
def stream_source_health(spark, sf):
    """The fetch log landed in a folder, which a stream follows until drained."""
    landing, health = scratch_path(spark, "runs"), scratch_path(spark, "health")
    log = I.fetch_runs(spark, sf)
    log.write.parquet(landing)
    runs = spark.readStream.schema(log.schema).parquet(landing)
    follow_health(runs, health, scratch_path(spark, "checkpoint")).awaitTermination()
    return current_health(spark, health).select(
        "source_id", I.text_stamp("last_fetched_at"), "error_count", "last_error"
    )


def _sources_with_health(spark, sf):
    """One source per user id, folded with the fetch log."""
    users = I.table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    stored = users.select(
        "id",
        F.lit(True).alias("is_active"),
        F.lit(None).cast("timestamp").alias("last_fetched_at"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(0).alias("error_count"),
        F.lit(_STORED_AT).cast("timestamp").alias("updated_at"),
    )
    health = catalog.source_health(I.fetch_runs(spark, sf))
    return catalog.apply_health(stored, health, I.run_date())


@query(
    "auto_deactivate",
    f"""WITH {_HEALTH_SQL}
        SELECT source_id AS id, error_count::INT AS error_count, error_count < 2 AS is_active
        FROM health""",
)
def auto_deactivate(spark, sf):
    return catalog.auto_deactivate(_sources_with_health(spark, sf), after=2).select(
        "id", "error_count", "is_active"
    )


@query(
    "fair_sources",
    f"""WITH {_HEALTH_SQL}
        SELECT source_id AS id, strftime(ok_at, '%Y-%m-%d %H:%M:%S') AS last_fetched_at
        FROM health
        WHERE error_count < 2 AND (ok_at IS NULL OR ok_at <= TIMESTAMP '2024-01-30 23:59:00')
        ORDER BY ok_at NULLS FIRST, source_id LIMIT 10""",
)
def fair_sources(spark, sf):
    sources = catalog.auto_deactivate(_sources_with_health(spark, sf), after=2)
    return catalog.fair_sources(sources, I.run_date()).select("id", I.text_stamp("last_fetched_at"))


@query(
    "batch_summary",
    """WITH per AS (
         SELECT user_id, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed,
                count(*) FILTER (event_type = 'purchase') AS inserted,
                count(*) FILTER (event_type IN ('view', 'click')) AS skipped,
                round(sum(round(value * 1000))) AS ms
         FROM events GROUP BY user_id)
       SELECT user_id AS source_id, count(*) AS sources_total,
              count(*) FILTER (failed = 0) AS sources_succeeded,
              count(*) FILTER (failed > 0) AS sources_failed, sum(runs)::BIGINT AS runs,
              sum(inserted)::BIGINT AS inserted, sum(skipped)::BIGINT AS skipped,
              sum(failed)::BIGINT AS errors, sum(ms)::BIGINT AS duration_ms
       FROM per GROUP BY ROLLUP (user_id)""",
)
def batch_summary(spark, sf):
    """Every event as the run of one source; null source_id is the total."""
    kind = F.col("event_type")
    runs = I.table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"),
        (kind != "error").alias("ok"),
        (kind == "purchase").cast("long").alias("inserted"),
        kind.isin("view", "click").cast("long").alias("skipped"),
        (kind == "error").cast("long").alias("errors"),
        F.round(F.col("value") * 1000).cast("long").alias("duration_ms"),
    )
    return catalog.batch_summary(runs)


@query(
    "source_lookup",
    """SELECT o.source_id, s_name AS name, s_suppkey IS NOT NULL AS found, n
       FROM (SELECT user_id AS source_id, count(*) AS n FROM events GROUP BY user_id) o
       LEFT JOIN supplier ON s_suppkey = o.source_id""",
)
def source_lookup(spark, sf):
    """Ids of the fetch log looked up in bulk; unknown ones are marked."""
    wanted = (
        I.table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hits = catalog.lookup_sources(
        I.credibility_sources(spark, sf).select("id", "name"), wanted, "id"
    )
    return hits.select(F.col("id").alias("source_id"), "name", "found", "n")


# --- Integrity --------------------------------------------------------------


@query(
    "fk_orphans",
    """SELECT 'orders.o_custkey' AS constraint_name, o_custkey AS missing_key, count(*) AS n_rows
       FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
       GROUP BY ALL
       UNION ALL
       SELECT 'lineitem.l_orderkey', l_orderkey, count(*) FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
       GROUP BY ALL
       UNION ALL
       SELECT 'lineitem.l_suppkey', l_suppkey, count(*) FROM lineitem
       WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY ALL""",
)
def fk_orphans(spark, sf):
    """Rows pointing at parents that are gone (debtors and pending orders)."""
    t = lambda name: I.table(spark, sf, name)
    checks = [
        ("orders", "o_custkey", t("customer").filter("c_acctbal >= 0"), "c_custkey"),
        ("lineitem", "l_orderkey", t("orders").filter("o_orderstatus <> 'P'"), "o_orderkey"),
        ("lineitem", "l_suppkey", t("supplier"), "s_suppkey"),
    ]
    reports = [
        dedup.fk_orphans(t(child), column, parent, key).select(
            F.lit(f"{child}.{column}").alias("constraint_name"), "missing_key", "n_rows"
        )
        for child, column, parent, key in checks
    ]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@query(
    "unique_key_violations",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
       GROUP BY ALL HAVING count(*) > 1""",
)
def unique_key_violations(spark, sf):
    return dedup.unique_key_violations(
        I.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


@query(
    "articles_with_source",
    """SELECT d.doc_id, d.source, s_name AS source_name,
              round((s_acctbal + 1000) / 11000, 4) AS credibility_score, l.quality
       FROM documents d LEFT JOIN supplier ON 'src' || s_suppkey = d.source
       LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def articles_with_source(spark, sf):
    """Articles with their source (many to one) and feedback (optional, one to one)."""
    sources = I.credibility_sources(spark, sf).select(
        F.concat(F.lit("src"), F.col("id")).alias("source"),
        F.col("name").alias("source_name"),
        "credibility_score",
    )
    return (
        I.table(spark, sf, "documents")
        .select("doc_id", "source")
        .join(sources, "source", "left")
        .join(I.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    )
