"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


def contamination_ctes(docs: str = "documents") -> str:
    """hit_items(doc_id, item), hit_words(doc_id, n_hit), doc_words(doc_id, ws)."""
    return rf"""
item_words AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS size,
               unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
        FROM item_words WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_words AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM {docs}),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
        FROM doc_words CROSS JOIN sizes WHERE len(ws) >= size)),
occurrences AS (SELECT d.doc_id, d.i, d.size, b.item_id
                FROM doc_windows d JOIN item_windows b ON d.size = b.size AND d.win = b.win),
hit_items AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occurrences),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM occurrences) GROUP BY doc_id)"""


def line_ctes(docs: str = "documents") -> str:
    """judged(doc_id, line, first_id, first_line, n_links, match_id, match_line): Jaccard of
    every two word sets that share a word, by counting shared words."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
split AS (SELECT doc_id, string_split({lower}, chr(10)) AS ls FROM {docs} WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS line FROM split),
worded AS (SELECT DISTINCT doc_id, line,
                  list_sort(list_distinct(regexp_extract_all(l, '[^ 	-
]+'))) AS ws FROM numbered),
lines AS (SELECT * FROM worded WHERE len(ws) > 0),
sets AS (SELECT ws, len(ws) AS n, arg_min(doc_id, (doc_id, line)) AS first_id, arg_min(line, (doc_id, line)) AS first_line,
                row_number() OVER () AS s FROM lines GROUP BY ws),
members AS (SELECT s, n, unnest(ws) AS w FROM sets),
shared AS (SELECT a.s AS s, b.s AS t, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o
           FROM members a JOIN members b ON a.w = b.w AND a.s <> b.s GROUP BY a.s, b.s),
links AS (SELECT s, t FROM shared WHERE 5 * o >= 4 * (n + m - o)),
partners AS (SELECT l.s, count(*) AS n_links, min((first_id, first_line)) AS there
             FROM links l JOIN sets x ON l.t = x.s GROUP BY l.s),
judged AS (SELECT l.doc_id, l.line, x.first_id, x.first_line, coalesce(p.n_links, 0) AS n_links,
                  CASE WHEN p.there < (x.first_id, x.first_line) THEN p.there[1] ELSE x.first_id END AS match_id,
                  CASE WHEN p.there < (x.first_id, x.first_line) THEN p.there[2] ELSE x.first_line END AS match_line
           FROM lines l JOIN sets x USING (ws) LEFT JOIN partners p ON p.s = x.s)"""


MIX_ENTROPY, MIX_REPEATS = 0.95, 4.0


def _hex_number(text: str) -> str:
    digits = f"list_transform(string_split(substr({text}, 1, 8), ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT)"
    return f"list_reduce({digits}, lambda a, b: a * 16 + b)"


def mixing_sql(docs: str = "documents") -> str:
    """Rows of the mixture; the exponent is bisected over a list of shares."""
    powers = "list_sum(list_transform(ps, lambda p: pow(p, {a})))"
    entropy = (
        f"(ln({powers}) - {{a}} * list_sum(list_transform(ps, lambda p: pow(p, {{a}}) * ln(p))) / {powers})"
    )
    repeats = f"(list_max(list_transform(ps, lambda p: exp(({{a}} - 1) * ln(p)))) / {powers})"
    middle = "((lo + hi) / 2)"

    def bisect(name: str, high_enough: str) -> str:
        return f"""
{name} AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, ps FROM shares
  UNION ALL
  SELECT step + 1, CASE WHEN {high_enough} THEN lo ELSE {middle} END,
         CASE WHEN {high_enough} THEN {middle} ELSE hi END, ps
  FROM {name} WHERE step < 24)"""

    return f"""
WITH RECURSIVE unit AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS key,
         sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS n_tokens
  FROM {docs} GROUP BY ALL),
sources AS (SELECT source, sum(n_tokens) AS total, count(*) AS n_units FROM unit GROUP BY source),
whole AS (SELECT sum(total)::DOUBLE AS t FROM sources),
shares AS (SELECT list(total / t ORDER BY source) AS ps FROM sources, whole WHERE total > 0),
{bisect("by_entropy", f"{entropy.format(a=middle)} < {MIX_ENTROPY} * ln(len(ps))")},
{bisect("by_repeats", f"{repeats.format(a=middle)} <= {MIX_REPEATS}")},
chosen AS (SELECT greatest((SELECT round(hi, 6) FROM by_entropy WHERE step = 24),
                           (SELECT round(hi, 6) FROM by_repeats WHERE step = 24)) AS a),
raised AS (SELECT source, total, n_units, CASE WHEN total > 0 THEN pow(total / t, a) ELSE 0 END AS r
           FROM sources, whole, chosen),
budgets AS (SELECT *, round(r / (SELECT sum(r) FROM raised) * t)::BIGINT AS budget FROM raised, whole),
planned AS (SELECT source, CASE WHEN total > 0 THEN budget // total ELSE 0 END AS passes,
                   CASE WHEN total > 0 THEN budget % total ELSE budget END AS rest,
                   ceil(n_units / 64)::BIGINT AS n_blocks FROM budgets),
dealt AS (SELECT u.doc_id, u.source, u.key, u.n_tokens, p.passes, p.rest,
                 {_hex_number("md5(u.key)")} % n_blocks AS block
          FROM unit u JOIN planned p USING (source)),
ordered AS (SELECT *, sum(n_tokens) OVER (
              PARTITION BY source
              ORDER BY md5(concat_ws('|', 'mix', passes + 1, source, block)), block,
                       md5(concat_ws('|', 'mix', passes + 1, key)), key
              ROWS UNBOUNDED PRECEDING) AS through FROM dealt),
counted AS (SELECT *, passes + CASE WHEN through - n_tokens < rest THEN 1 ELSE 0 END AS times FROM ordered),
passed AS (SELECT *, unnest(range(1, times::BIGINT + 1)) AS pass FROM counted)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, pass::INTEGER AS pass, block::BIGINT AS block,
       md5(concat_ws('|', 'mix', pass, source, block)) AS order_key FROM passed"""


def resample_sql(docs: str = "documents") -> str:
    """crc32 is worked out byte by byte, for each word once."""
    byte = "('0x' || substr(h, 2 * i - 1, 2))::BIGINT"
    table = "CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END"
    return rf"""
WITH RECURSIVE poly AS (
  SELECT 0 AS k, i::BIGINT AS i, i::BIGINT AS t FROM range(256) r(i)
  UNION ALL SELECT k + 1, i, {table} FROM poly WHERE k < 8),
tables AS (SELECT list(t ORDER BY i) AS ts FROM poly WHERE k = 8),
words AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM {docs}),
item_words AS (SELECT unnest({_WORDS}) AS w FROM benchmark WHERE text IS NOT NULL),
grams AS (SELECT doc_id, unnest(ws) AS w FROM words),
vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM grams UNION ALL SELECT w FROM item_words)),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: {byte}),
         lambda c, b: xor(c >> 8, ts[xor(c & 255, b) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM vocabulary, tables),
s AS (SELECT bucket, count(*) AS n FROM grams JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM item_words JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
           / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT doc_id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
            FROM grams JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
           FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)"""


def search_sql(docs: str = "documents") -> str:
    return rf"""
WITH grams AS (SELECT doc_id, unnest({_WORDS}) AS w FROM {docs} WHERE text IS NOT NULL),
lengths AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
item_terms AS (SELECT item_id, unnest(list_distinct({_WORDS})) AS w FROM benchmark WHERE text IS NOT NULL),
counted AS (SELECT doc_id, w, count(*) AS tf FROM grams WHERE w IN (SELECT w FROM item_terms) GROUP BY ALL),
weights AS (SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
            FROM counted, whole GROUP BY w, n_docs),
norms AS (SELECT doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM lengths, whole),
scored AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM item_terms JOIN counted USING (w) JOIN weights USING (w) JOIN norms USING (doc_id) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 10"""


WARC_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
digests AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS last
            FROM payloads),
numbers AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(d, 5 * k + 1, 5))::BIGINT) AS groups FROM digests)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_reduce(list_transform(groups, lambda g: list_reduce(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g >> s) & 31)::INTEGER, 1)), lambda a, b: a || b)),
         lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to, NULL::VARCHAR AS problem
FROM numbers"""


SQL = {
    "op5_decontaminate": f"""
WITH {contamination_ctes()},
digests AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM hit_items GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(g.n_items, 0) AS n_items,
       sha256(coalesce(g.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN digests g USING (doc_id)""",
    "op6_lines": f"""
WITH {line_ctes()}
SELECT doc_id, line::INTEGER AS line, first_id, first_line::INTEGER AS first_line, n_links, match_id,
       match_line::INTEGER AS match_line, NOT (match_id = doc_id AND match_line = line) AS removed FROM judged""",
    "op7_mixing": mixing_sql(),
    "op11_resample": resample_sql(),
    "op12_search": search_sql(),
    "op13_warc": WARC_SQL,
}
