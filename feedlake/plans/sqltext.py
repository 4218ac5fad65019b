"""SQL fragments that restate the cleaning rules for an independent engine.

Written for DuckDB, on the supplied tables (whose text is already NFKC and holds
a handful of entities).
"""

from __future__ import annotations

from feedlake import config as C


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def delete(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, {quote(pattern)}, {quote(by)}, 'g')"


_ATTR = r"""(?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*"""
_BLOCK = rf"(?i)<(?:{'|'.join(C.BLOCK_ELEMENTS)})(?:[\s/]{_ATTR})?>"
_MARKUP = rf"(?s)<!--.*?(?:-->|$)|<[!?][^>]*>|</?[A-Za-z]{_ATTR}>"
_SCRIPTS = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def plain(expr: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        expr = f"replace({expr}, {quote(entity)}, {quote(char)})"
    return delete(expr, "&amp;?", "&")


def strip(expr: str, scripts: bool = True) -> str:
    if scripts:
        expr = delete(expr, _SCRIPTS)
    # A line break cannot be written in a literal here, chr(10) can.
    expr = f"regexp_replace({expr}, {quote(_BLOCK)}, chr(10), 'g')"
    return delete(expr, _MARKUP)


def collapse(expr: str) -> str:
    return f"trim({delete(expr, _SPACE + '+', ' ')})"


def trim_space(expr: str) -> str:
    return delete(expr, f"^{_SPACE}+|{_SPACE}+$")


def _delete_all(expr: str, patterns: tuple[str, ...], flags: str) -> str:
    for pattern in patterns:
        expr = delete(expr, f"(?{flags}){pattern}")
    return expr


def title(expr: str) -> str:
    cleaned = collapse(delete(strip(plain(expr)), "<[^>]*>"))
    cleaned = _delete_all(cleaned, C.TITLE_SQL_PATTERNS, "i")
    return f"coalesce(nullif({cleaned}, ''), {quote(C.DEFAULT_TITLE)})"


def summary(expr: str) -> str:
    scripts = tuple(rf"\b{p}" if p.startswith("on") else p for p in C.SUMMARY_SCRIPT_PATTERNS)
    cleaned = _delete_all(strip(plain(expr)), scripts, "is")
    cleaned = _delete_all(cleaned, C.SUMMARY_SQL_PATTERNS, "i")
    return f"nullif(substr({collapse(cleaned)}, 1, {C.SUMMARY_MAX_LEN}), '')"


def compat_title(expr: str) -> str:
    cleaned = collapse(delete(plain(strip(expr, False)), "<[^>]*>"))
    cleaned = _delete_all(cleaned, C.TITLE_SQL_PATTERNS, "i")
    return f"coalesce(nullif({cleaned}, ''), {quote(C.DEFAULT_TITLE)})"


def compat_summary(expr: str) -> str:
    spelt = f"replace({delete(strip(expr, False), '&([A-Za-z]+;)', chr(1) + chr(92) + '1')}, '&', '&amp;')"
    spelt = f"replace({spelt}, chr(1), '&')"
    cleaned = _delete_all(spelt, C.SUMMARY_SCRIPT_PATTERNS, "is")
    cleaned = _delete_all(cleaned, C.SUMMARY_SQL_PATTERNS, "i")
    return f"nullif(substr({collapse(plain(cleaned))}, 1, {C.SUMMARY_MAX_LEN}), '')"


def author(expr: str) -> str:
    return f"nullif({trim_space(strip(plain(expr)))}, '')"


def tags(expr: str) -> str:
    """First spelling of each tag, sorted by code point."""
    one = trim_space(strip(plain("t")))
    cleaned = f"list_filter(list_transform({expr}, lambda t: {one}), lambda t: t <> '')"
    kept = (
        f"list_filter({cleaned}, lambda t, i: "
        f"list_position(list_transform({cleaned}, lambda u: lower(u)), lower(t)) = i)"
    )
    return f"list_sort({kept})"


_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?.*$"


def url(expr: str, tracking: tuple[str, ...] = C.TRACKING_PARAMS, legacy: bool = False) -> str:
    def part(i: int) -> str:
        return f"regexp_extract(trim({expr}), {quote(_URL)}, {i})"

    listed = ", ".join(quote(t) for t in tracking)
    pairs = f"list_filter(string_split({part(4)}, '&'), lambda t: regexp_matches(t, '(?s)=.'))"
    decode = "url_decode(replace({0}, '+', ' '))"
    name = decode.format("split_part(t, '=', 1)")
    value = decode.format("regexp_replace(t, '(?s)^[^=]*=', '')")
    structs = (
        f"list_transform({pairs}, lambda t, i: {{'k': {name}, 'i': i, 'v': {value}}})"
    )
    kept = f"list_filter({structs}, lambda p: lower(p.k) NOT IN ({listed}))"
    ordered = kept if legacy else f"list_sort({kept})"
    enc = "replace(url_encode({0}), '%20', '+')"
    query = (
        f"array_to_string(list_transform({ordered}, "
        f"lambda p: {enc.format('p.k')} || '=' || {enc.format('p.v')}), '&')"
    )
    if legacy:
        base = f"lower({part(1)}) || '://' || lower({part(2)}) || {part(3)}"
    else:
        base = (
            f"lower({part(1)}) || '://' || lower({part(2)}) || "
            f"CASE WHEN {part(3)} = '/' THEN '/' ELSE regexp_replace({part(3)}, '/$', '') END"
        )
    return f"({base} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END)"


def host(expr: str) -> str:
    return f"lower(split_part({expr}, '/', 3))"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S+00:00')"


def link_stamp(link: str) -> str:
    return f"('fallback:' || substr(sha256({link}), 1, 8))"


def content_hash(title_: str, link: str, moment: str, summary_: str | None) -> str:
    tail = (
        f" || '|' || coalesce(substr({summary_}, 1, {C.HASH_SUMMARY_PREFIX_LEN}), '')"
        if summary_
        else ""
    )
    return (
        f"sha256(lower({title_}) || '|' || {link} || '|' || "
        f"coalesce({stamp(moment)}, {link_stamp(link)}){tail})"
    )


def words(expr: str) -> str:
    return rf"regexp_extract_all(lower({expr}), '[\p{{L}}\p{{N}}_]+')"


STOP_LIST = ", ".join(quote(w) for w in C.STOP_WORDS)

PAGE_ENTRIES = r"""
page_entries AS (
  SELECT page_id, lower(split_part(url, '/', 3)) AS host, url AS link, html AS summary,
         regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
         regexp_extract(html, '(?is)<meta name="author" content="([^"]*)"', 1) AS author,
         regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS tags,
         CASE WHEN url LIKE 'https%'
              THEN TIMESTAMP '2024-01-01' + to_minutes((page_id % 43200)::INT) END AS published_at
  FROM pages)
"""

DOC_ENTRIES = r"""
doc_entries AS (
  SELECT doc_id, source, replace(source, 'src', '')::BIGINT AS source_id,
         split_part(text, chr(10), 1) AS title,
         'https://news.example.com/' || substr(sha256(text), 1, 16) AS link,
         text AS summary, lang AS author, [lang, upper(lang), source] AS tags
  FROM documents)
"""


def page_articles(profile: str = "strict") -> str:
    """CTEs page_entries and page_articles."""
    if profile == "strict":
        fields = f"""{title('title')} AS title, {url('link')} AS link,
               {summary('summary')} AS summary, {author('author')} AS author,
               {tags('tags')} AS tags"""
        hashed = content_hash("title", "link", "published_at", "summary")
    else:
        fields = f"""{compat_title('title')} AS title, {url('link')} AS link,
               {compat_summary('summary')} AS summary"""
        moment = "coalesce(published_at, TIMESTAMP '2024-01-31')"
        again = url("link")
        hashed = content_hash(compat_title("lower(title)"), again, moment, compat_summary("summary"))
    return f"""{PAGE_ENTRIES},
page_clean AS (
  SELECT page_id, host, published_at, {fields} FROM page_entries),
page_articles AS (
  SELECT *, {hashed} AS content_hash FROM page_clean)
"""


def doc_articles() -> str:
    """CTEs doc_entries and doc_articles."""
    hashed = content_hash("title", "link", "NULL::TIMESTAMP", "summary")
    return f"""{DOC_ENTRIES},
doc_clean AS (
  SELECT doc_id, source, source_id, {title('title')} AS title, {url('link')} AS link,
         {summary('summary')} AS summary, {author('author')} AS author, {tags('tags')} AS tags
  FROM doc_entries),
doc_articles AS (
  SELECT *, {hashed} AS content_hash FROM doc_clean)
"""
