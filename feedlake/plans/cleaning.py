"""Queries over the cleaning functions and entry mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions import dates, text, urls
from feedlake.operators import entries, networks, validation
from feedlake.plans import inputs as I
from feedlake.plans import sqltext as S
from feedlake.plans.registry import query
from feedlake.session import spread


@query(
    "normalize_title",
    f"WITH {S.PAGE_ENTRIES} SELECT page_id, {S.title('title')} AS title FROM page_entries",
)
def normalize_title(spark, sf):
    return I.page_entries(spark, sf).select(
        "page_id", text.normalize_title(F.col("title")).alias("title")
    )


@query("canonical_url", f"SELECT page_id, {S.url('url')} AS link FROM pages")
def canonical_url(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id", urls.canonicalize_url(F.col("url")).alias("link")
    )


@query(
    "normalize_summary",
    f"""SELECT 'page' AS kind, page_id AS id, {S.summary('html')} AS summary FROM pages
        UNION ALL
        SELECT 'document', doc_id, {S.summary('text')} FROM documents""",
)
def normalize_summary(spark, sf):
    pages = I.pages_table(spark, sf).select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("raw")
    )
    docs = I.documents_table(spark, sf).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw")
    )
    return pages.unionByName(docs).select(
        "kind", "id", text.normalize_summary(F.col("raw")).alias("summary")
    )


@query(
    "normalize_author",
    f"""SELECT conv_id, turn, {S.author("'  <b>' || role || '</b> &amp; co '")} AS author
        FROM conversations""",
)
def normalize_author(spark, sf):
    marked = F.concat(F.lit("  <b>"), F.col("role"), F.lit("</b> &amp; co "))
    return (
        I.table(spark, sf, "conversations")
        .select("conv_id", "turn", marked.alias("raw"))
        .select("conv_id", "turn", text.normalize_author(F.col("raw")).alias("author"))
    )


_RAW_TAG = S.trim_space(S.strip(S.plain("raw")))


@query(
    "normalize_tags",
    f"""WITH items AS (
          SELECT doc_id, unnest(string_split(text, ' ')) AS raw,
                 generate_subscripts(string_split(text, ' '), 1) AS i
          FROM documents),
        cleaned AS (SELECT doc_id, i, {_RAW_TAG} AS tag FROM items),
        kept AS (
          SELECT doc_id, arg_min(tag, i) AS tag FROM cleaned WHERE tag <> ''
          GROUP BY doc_id, lower(tag))
        SELECT doc_id, coalesce(string_agg(tag, '|' ORDER BY tag), '') AS tags,
               count(tag)::INT AS n_tags
        FROM documents LEFT JOIN kept USING (doc_id) GROUP BY doc_id""",
)
def normalize_tags(spark, sf):
    return (
        I.documents_table(spark, sf)
        .select("doc_id", F.split("text", " ").alias("raw"))
        .select("doc_id", text.normalize_tags(F.col("raw")).alias("tags"))
        .select("doc_id", F.array_join("tags", "|").alias("tags"), F.size("tags").alias("n_tags"))
    )


@query(
    "nfkc_text",
    """SELECT doc_id, sha256(text) AS text_sha, length(text)::BIGINT AS n_chars FROM documents""",
)
def nfkc_text(spark, sf):
    return (
        I.documents_table(spark, sf)
        .select("doc_id", text.nfkc(F.col("text")).alias("t"))
        .select(
            "doc_id",
            F.sha2("t", 256).alias("text_sha"),
            F.length("t").cast("long").alias("n_chars"),
        )
    )


#: Date shapes feeds use, by number; those from 10 on drop the seconds or the time.
_DATE_SHAPES = (
    "'Mon, 'dd MMM yyyy HH:mm:ss' GMT'",
    "'Tue, 'd MMM yy HH:mm:ss' +0000'",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss'.1234567Z'",
    "yyyy-MM-dd HH:mm:ss'+00'",
    "yyyyMMdd'T'HHmmss'Z'",
    "'Wed 'MMM d HH:mm:ss yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy h:mm:ss a",
    "yyyy/MM/dd HH:mm:ss",
    "MMMM d, yyyy h:mm a",
    "d MMMM yyyy",
    "MMMM yyyy",
)


@query(
    "parse_published",
    """WITH stamped AS (
         SELECT o_orderkey, o_orderkey % 13 AS kind,
                o_orderdate + to_seconds(((o_orderkey * 7919) % 86400)::INT) AS t FROM orders)
       SELECT o_orderkey,
              CASE WHEN kind = 12 THEN '2024-01-31 00:00:00' WHEN kind = 11 THEN strftime(t, '%Y-%m-%d 00:00:00')
                   WHEN kind = 10 THEN strftime(t, '%Y-%m-%d %H:%M:00')
                   ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS published_at,
              kind = 12 AS is_fallback_date
       FROM stamped""",
)
def parse_published(spark, sf):
    """Order times rendered in thirteen shapes; the last one is no date."""
    orders = I.table(spark, sf, "orders")
    moment = F.timestamp_add("SECOND", F.col("o_orderkey") * 7919 % 86400, "o_orderdate")
    shown = F.lit(None).cast("string")
    for kind, shape in enumerate(_DATE_SHAPES):
        shown = F.when(F.col("o_orderkey") % 13 == kind, F.date_format(moment, shape)).otherwise(shown)
    parsed = orders.select("o_orderkey", shown.alias("raw")).withColumn(
        "parsed", dates.parse_published(F.col("raw"))
    )
    return parsed.select(
        "o_orderkey",
        F.date_format(F.coalesce("parsed", I.run_date()), "yyyy-MM-dd HH:mm:ss").alias(
            "published_at"
        ),
        F.col("parsed").isNull().alias("is_fallback_date"),
    )


@query(
    "content_hash",
    f"""WITH {S.page_articles()}, {S.doc_articles()}
        SELECT 'page' AS kind, page_id AS id, content_hash FROM page_articles
        UNION ALL SELECT 'document', doc_id, content_hash FROM doc_articles""",
)
def content_hash(spark, sf):
    pages = entries.map_articles(I.page_entries(spark, sf), I.run_date())
    docs = entries.map_articles(I.document_entries(spark, sf), I.run_date())
    return pages.select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), "content_hash"
    ).unionByName(
        docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "content_hash")
    )


@query(
    "content_hash_compat",
    f"""WITH {S.page_articles('compat')}
        SELECT page_id, title, link, substr(summary, 1, 200) AS summary_start,
               length(summary)::INT AS summary_length, content_hash FROM page_articles""",
)
def content_hash_compat(spark, sf):
    pages = entries.map_articles(I.page_entries(spark, sf), I.run_date(), profile="compat")
    return pages.select(
        "page_id",
        "title",
        "link",
        F.substring("summary_raw", 1, C.PREVIEW_LEN).alias("summary_start"),
        F.length("summary_raw").alias("summary_length"),
        "content_hash",
    )


@query(
    "normalize_entries",
    f"""WITH {S.page_articles()}
        SELECT page_id, title, link, summary, author, array_to_string(tags, '|') AS tags,
               strftime(coalesce(published_at, TIMESTAMP '2024-01-31'), '%Y-%m-%d %H:%M:%S')
                 AS published_at,
               published_at IS NULL AS is_fallback_date
        FROM page_articles""",
)
def normalize_entries(spark, sf):
    rows = entries.normalize_entries(I.page_entries(spark, sf), I.run_date())
    return rows.select(
        "page_id",
        "title",
        "link",
        "summary",
        "author",
        F.array_join("tags", "|").alias("tags"),
        I.text_stamp("published_at"),
        "is_fallback_date",
    )


@query(
    "map_articles",
    f"""WITH {S.page_articles()}
        SELECT 1::BIGINT AS source_id, title, link, summary AS summary_raw, content_hash,
               strftime(coalesce(published_at, TIMESTAMP '2024-01-31'), '%Y-%m-%d %H:%M:%S')
                 AS published_at,
               author, array_to_string(tags, '|') AS tags
        FROM page_articles""",
)
def map_articles(spark, sf):
    rows = entries.map_articles(I.page_entries(spark, sf), I.run_date())
    return rows.select(
        "source_id",
        "title",
        "link",
        "summary_raw",
        "content_hash",
        I.text_stamp("published_at"),
        "author",
        F.array_join("tags", "|").alias("tags"),
    )


@query(
    "field_fallbacks",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'short: ' || source ELSE text END AS raw_summary,
              CASE lang WHEN 'de' THEN '2024-01-02' WHEN 'fr' THEN '2024-01-03' END AS raw_published,
              lang || '|' || upper(lang) || '|' || source AS raw_tags
       FROM documents""",
)
def field_fallbacks(spark, sf):
    """English entries have a summary beside the description, German ones both dates,
    French ones the date of their update only."""
    lang = F.col("author")
    given = I.document_entries(spark, sf).withColumns(
        {
            "summary": F.when(lang == "en", F.concat(F.lit("short: "), "source")).otherwise(""),
            "published": F.when(lang == "de", "2024-01-02").otherwise(""),
            "updated": F.when(lang.isin("de", "fr"), "2024-01-03"),
        }
    )
    rows = entries.field_fallbacks(given)
    return rows.select(
        "doc_id", "raw_summary", "raw_published", F.array_join("raw_tags", "|").alias("raw_tags")
    )


def _legacy_sql(expr: str) -> str:
    out = S.strip(expr, scripts=False)
    for pattern in C.LEGACY_SCRIPT_PATTERNS:
        out = S.delete(out, f"(?is){pattern}")
    out = S.delete(out, C.LEGACY_ENTITY_PATTERN + "|[&<>]")
    out = S.delete(out, r"(?i)on\w+\s*=")
    for pattern in C.LEGACY_SQL_PATTERNS:
        out = S.delete(out, f"(?i){pattern}")
    return S.trim_space(f"substr({out}, 1, {C.SUMMARY_MAX_LEN})")


def _legacy_title_sql(expr: str) -> str:
    out = _legacy_sql(expr)
    for keyword in C.LEGACY_TITLE_KEYWORDS:
        out = f"replace(replace({out}, {S.quote(keyword)}, ''), {S.quote(keyword.lower())}, '')"
    return f"coalesce(nullif({out}, ''), {S.quote(C.DEFAULT_TITLE)})"


@query(
    "legacy_articles",
    f"""WITH {S.PAGE_ENTRIES}, cleaned AS (
          SELECT page_id, published_at, {_legacy_title_sql('title')} AS title,
                 {S.url('link', C.LEGACY_TRACKING_PARAMS, legacy=True)} AS link,
                 nullif({_legacy_sql('summary')}, '') AS summary_raw,
                 list_filter(list_transform(tags, lambda t: {_legacy_sql('t')}),
                             lambda t: t <> '') AS tags
          FROM page_entries)
        SELECT page_id, title, link, summary_raw, array_to_string(tags, '|') AS tags,
               {S.content_hash('title', 'link', 'published_at', None)} AS content_hash
        FROM cleaned""",
)
def legacy_articles(spark, sf):
    rows = entries.map_articles(I.page_entries(spark, sf), I.run_date(), profile="legacy")
    return rows.select(
        "page_id",
        "title",
        "link",
        "summary_raw",
        F.array_join("tags", "|").alias("tags"),
        "content_hash",
    )


@query(
    "alternate_link",
    """SELECT page_id, 'https://' || lower(split_part(url, '/', 3)) || '/alt' AS link FROM pages""",
)
def alternate_link(spark, sf):
    """Entries without a link, with two link elements each."""
    from feedlake.functions.legacy import first_alternate_link

    base = F.concat(F.lit("https://"), urls.url_host(F.col("url")))
    links = F.array(
        F.struct(F.lit("self").alias("rel"), F.concat(base, F.lit("/self")).alias("href")),
        F.struct(F.lit("alternate").alias("rel"), F.concat(base, F.lit("/alt")).alias("href")),
        F.struct(F.lit("alternate").alias("rel"), F.concat(base, F.lit("/alt2")).alias("href")),
    )
    return I.table(spark, sf, "pages").select(
        "page_id", first_alternate_link(F.lit(""), links).alias("link")
    )


@query(
    "validate_articles",
    f"""WITH {S.doc_articles()}
        SELECT doc_id,
               concat_ws(',', CASE WHEN source_id <= 0 THEN 'source_id' END,
                              CASE WHEN length(title) > 512 THEN 'title_too_long' END) AS violations,
               true AS link_scheme_ok
        FROM doc_articles""",
)
def validate_articles(spark, sf):
    rows = entries.map_articles(I.document_entries(spark, sf), I.run_date())
    return validation.validate_articles(rows, check_lengths=True).select(
        "doc_id", F.array_join("violations", ",").alias("violations"), "link_scheme_ok"
    )


@query(
    "quarantine_articles",
    f"""WITH {S.doc_articles()}
        SELECT doc_id, title, 'source_id' AS violations FROM doc_articles WHERE source_id <= 0""",
)
def quarantine_articles(spark, sf):
    rows = entries.map_articles(I.document_entries(spark, sf), I.run_date())
    return validation.rejected(validation.validate_articles(rows)).select(
        "doc_id", "title", F.array_join("violations", ",").alias("violations")
    )


@query(
    "validate_sources",
    """SELECT s_suppkey AS id,
              concat_ws(',', CASE WHEN s_nationkey < 3 THEN 'name' END,
                             CASE WHEN s_acctbal < 0 OR s_acctbal > 5000 THEN 'credibility_score' END)
                AS violations
       FROM supplier""",
)
def validate_sources(spark, sf):
    """Scores outside 0..1 and blank names are reported."""
    sources = I.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_nationkey") < 3, F.lit(" \n ")).otherwise(F.col("s_name")).alias("name"),
        F.lit("https://example.com").alias("url"),
        F.lit("https://example.com/feed").alias("feed_url"),
        (F.col("s_acctbal") / 5000).alias("credibility_score"),
    )
    return validation.validate_sources(sources).select(
        "id", F.array_join("violations", ",").alias("violations")
    )


@query(
    "url_policy",
    """SELECT page_id, url, CASE WHEN url LIKE 'http%' THEN NULL ELSE 'scheme' END AS violation
       FROM pages
       UNION ALL SELECT page_id, replace(replace(url, 'https:', 'ftp:'), 'http:', 'file:'), 'scheme'
       FROM pages
       UNION ALL SELECT page_id, replace(url, split_part(url, '/', 3), 'localhost:8080'), 'localhost'
       FROM pages""",
)
def url_policy(spark, sf):
    """Page addresses as they are, with a bad scheme, and with a local host."""
    pages = I.table(spark, sf, "pages").select("page_id", "url")
    bad_scheme = F.replace(
        F.replace(F.col("url"), F.lit("https:"), F.lit("ftp:")), F.lit("http:"), F.lit("file:")
    )
    local = F.replace(F.col("url"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("localhost:8080"))
    variants = pages.select(
        "page_id", F.explode(F.array(F.col("url"), bad_scheme, local)).alias("url")
    )
    return variants.withColumn("violation", urls.url_violation(F.col("url")))


@query(
    "blocked_networks",
    """WITH hosts AS (
         SELECT s_suppkey, (s_suppkey * 2654435761) % 4294967296 AS ip FROM supplier
         UNION ALL SELECT s_suppkey, 167772160 + s_suppkey FROM supplier
         UNION ALL SELECT s_suppkey, 2886729728 + s_suppkey * 16384 FROM supplier
         UNION ALL SELECT s_suppkey, 3232235520 + s_suppkey * 1024 FROM supplier)
       SELECT s_suppkey,
              (ip // 16777216) || '.' || (ip // 65536 % 256) || '.' || (ip // 256 % 256)
                || '.' || (ip % 256) AS host,
              CASE WHEN ip // 16777216 = 10 THEN '10.0.0.0/8'
                   WHEN ip // 1048576 = 2753 THEN '172.16.0.0/12'
                   WHEN ip // 65536 = 49320 THEN '192.168.0.0/16'
                   WHEN ip // 16777216 = 127 THEN '127.0.0.0/8'
                   WHEN ip // 65536 = 43518 THEN '169.254.0.0/16' END AS network
       FROM hosts""",
)
def blocked_networks(spark, sf):
    """IPv4 hosts made from supplier keys, near and inside the blocked networks."""
    key = F.col("s_suppkey")
    number = F.explode(
        F.array(
            (key * 2654435761) % 4294967296,
            F.lit(167772160) + key,
            F.lit(2886729728) + key * 16384,
            F.lit(3232235520) + key * 1024,
        )
    )
    ips = I.table(spark, sf, "supplier").select("s_suppkey", number.alias("ip"))
    octets = [F.floor(F.col("ip") / 2**shift) % 256 for shift in (24, 16, 8, 0)]
    host = F.concat_ws(".", *[o.cast("string") for o in octets])
    return ips.select("s_suppkey", host.alias("host")).withColumn(
        "network", urls.blocked_network(F.col("host"))
    )


@query(
    "suspicious_content",
    f"""SELECT page_id, preview FROM (
          SELECT page_id, substr(s, 1, 200) AS preview, s FROM (
            SELECT page_id, {S.summary("'<p>' || html || '</p> prescription ' || (page_id % 3)")} AS s
            FROM pages))
        WHERE regexp_matches(s, '(?i)script|javascript|eval|alert')""",
)
def suspicious_content(spark, sf):
    """Cleaned pages, with a harmless trigger word appended to each."""
    raw = F.concat(
        F.lit("<p>"), F.col("html"), F.lit("</p> prescription "), (F.col("page_id") % 3)
    )
    cleaned = (
        I.pages_table(spark, sf)
        .select("page_id", raw.alias("raw"))
        .select("page_id", text.normalize_summary(F.col("raw")).alias("summary_raw"))
    )
    return entries.suspicious_summaries(cleaned).select(
        "page_id", F.col("summary_preview").alias("preview")
    )


@query(
    "hash_stability",
    f"""WITH {S.page_articles()}
        SELECT page_id, content_hash, 1::BIGINT AS n_hashes, 4::BIGINT AS n_variants
        FROM page_articles""",
)
def hash_stability(spark, sf):
    """Harmless changes to an entry must not change its hash."""
    base = I.page_entries(spark, sf).drop("tags")
    ascii_upper = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    no_fragment = F.regexp_replace("link", "#.*$", "")
    joiner = F.when(F.col("link").contains("?"), F.lit("&")).otherwise(F.lit("?"))
    variants = {
        0: (F.col("title"), F.col("link"), F.col("summary")),
        1: (
            F.concat(F.lit(" \n <i>"), F.regexp_replace("title", " ", "  \t"), F.lit("</i> ")),
            F.concat(no_fragment, joiner, F.lit("UTM_Campaign=x&fbclid=1#frag")),
            F.concat(F.lit("<div>\n"), F.col("summary"), F.lit("</div>")),
        ),
        2: (
            F.regexp_replace(F.translate("title", *ascii_upper), "&AMP;", "&amp;"),
            F.concat(F.lit("  "), F.col("link"), F.lit("\n")),
            F.regexp_replace("summary", "<p>", '\n<p class="x">'),
        ),
        3: (
            F.concat(F.col("title"), F.lit("<!-- note -->")),
            F.regexp_replace("link", "^(https?)://([^/]*)", "$1://$2"),
            F.concat(F.col("summary"), F.lit("<br/>")),
        ),
    }
    structs = F.array(
        *[
            F.struct(t.alias("title"), link.alias("link"), s.alias("summary"))
            for t, link, s in variants.values()
        ]
    )
    mutated = (
        base.withColumn("v", F.explode(structs))
        .drop("title", "link", "summary")
        .select("*", "v.*", F.array().cast("array<string>").alias("tags"))
        .drop("v")
    )
    hashed = entries.map_articles(mutated, I.run_date())
    return hashed.groupBy("page_id").agg(
        F.min("content_hash").alias("content_hash"),
        F.countDistinct("content_hash").alias("n_hashes"),
        F.count(F.lit(1)).alias("n_variants"),
    )


_DOTTED = "({0} // 16777216) || '.' || ({0} // 65536 % 256) || '.' || ({0} // 256 % 256) || '.' || ({0} % 256)"


def _dotted(number):
    octets = [(F.floor(number / 2**shift) % 256).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


@query(
    "longest_network",
    f"""WITH nets AS (
         SELECT (s_suppkey * 2654435761) % 4294967296 AS net, 4 + (s_suppkey % 29) AS bits,
                {_DOTTED.format('((s_suppkey * 2654435761) % 4294967296)')} || '/' || (4 + s_suppkey % 29) AS network
         FROM supplier),
       hosts AS (
         SELECT DISTINCT (c_custkey * 2654435761 + (c_custkey % 7) * 3000) % 4294967296 AS ip FROM customer
         UNION SELECT (o_orderkey * 40503 * 65537) % 4294967296 FROM orders),
       met AS (
         SELECT ip, bits, min(network) AS network FROM hosts JOIN nets
         ON ip // (1::BIGINT << (32 - bits)) = net // (1::BIGINT << (32 - bits)) GROUP BY ip, bits)
       SELECT {_DOTTED.format('ip')} AS host, arg_max(network, bits) AS network FROM met GROUP BY ip""",
)
def longest_network(spark, sf):
    """A block list as long as the supplier table; customers and orders make the hosts."""
    key = F.col("s_suppkey").cast("long")
    network = F.concat_ws("/", _dotted((key * 2654435761) % 4294967296), (4 + key % 29).cast("string"))
    listed = I.table(spark, sf, "supplier").select(network.alias("network"))
    buyer, order = F.col("c_custkey").cast("long"), F.col("o_orderkey").cast("long")
    hosts = I.table(spark, sf, "customer").select(_dotted((buyer * 2654435761 + (buyer % 7) * 3000) % 4294967296).alias("host"))
    more = I.table(spark, sf, "orders").select(_dotted((order * 40503 * 65537) % 4294967296).alias("host"))
    return networks.longest_network(hosts.unionByName(more), listed)
