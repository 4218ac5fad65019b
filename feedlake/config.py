"""Settings of the library and the fixed values its results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values -----------------------------------------------------------
# Results (hashes above all) depend on these lists, limits and patterns, so
# they are given values and not tuning knobs.

DEFAULT_TITLE = "Untitled Article"
DEFAULT_FEED_TITLE = "Unknown Feed"
DEFAULT_CREDIBILITY = 0.5

SUMMARY_MAX_LEN = 4000
HASH_SUMMARY_PREFIX_LEN = 100
ERROR_MAX_LEN = 1000
PREVIEW_LEN = 200
MAX_PAYLOAD_BYTES = 10 * 1024 * 1024

TRACKING_PARAMS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "fbclid",
    "gclid",
    "mc_cid",
    "mc_eid",
)

LEGACY_TRACKING_PARAMS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "fbclid",
    "gclid",
    "msclkid",
    "ref",
    "source",
    "medium",
)

BLOCKED_NETWORKS = (
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "::1/128",
    "fc00::/7",
    "fe80::/10",
)

ALLOWED_URL_SCHEMES = ("http", "https")

ALLOWED_ENCODINGS = ("utf-8", "utf-16", "iso-8859-1", "windows-1252", "ascii")

# Deleted from titles, in this order, ignoring case.
TITLE_SQL_PATTERNS = (
    r"DELETE\s+FROM",
    r"INSERT\s+INTO",
    r"UPDATE\s+.*\s+SET",
    r"DROP\s+TABLE",
    r";\s*--",
    r"--\s*$",
)

# Deleted from summaries, in this order, ignoring case; "." spans lines.
SUMMARY_SCRIPT_PATTERNS = (
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"alert\s*\(",
    r"eval\s*\(",
    r"document\.",
    r"window\.",
    r"location\.",
    r"on\w+\s*=",
)

# Deleted from summaries after the script patterns, in this order, ignoring case.
SUMMARY_SQL_PATTERNS = (
    r"DELETE\s+FROM",
    r"INSERT\s+INTO",
    r"UPDATE\s+.*\s+SET",
    r"DROP\s+TABLE",
    r";\s*--",
)

# Legacy profile: deleted in this order, ignoring case.
LEGACY_SCRIPT_PATTERNS = (
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"alert\s*\(",
    r"eval\s*\(",
    r"document\.|window\.|location\.",
)
LEGACY_ENTITY_PATTERN = r"&[a-zA-Z0-9#]+;"
LEGACY_SQL_PATTERNS = (
    r"DELETE\s+FROM",
    r"UPDATE\s+",
    r"INSERT\s+INTO",
    r"DROP\s+TABLE",
)
LEGACY_TITLE_KEYWORDS = ("DELETE FROM", "UPDATE ", "INSERT INTO", "DROP TABLE", "; --", "--")

SUSPICIOUS_WORDS = ("script", "javascript", "eval", "alert")

# HTML elements whose start tag separates text when markup is stripped.
BLOCK_ELEMENTS = (
    "address", "article", "aside", "blockquote", "details", "dialog", "dd",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main",
    "nav", "ol", "p", "pre", "section", "table", "ul",
)

# Characters the text rules treat as white space: the blank, other Latin-1 ones
# and the rest (more than Java's own class).
WHITESPACE_LATIN1 = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
WHITESPACE_OTHER = (
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE = " " + WHITESPACE_LATIN1 + WHITESPACE_OTHER

# --- End of fixed values ----------------------------------------------------

# Named entities decoded with JVM string functions; text holding any other
# entity goes through the Arrow decoder. "&amp;" comes last so that one pass
# never decodes the output of another.
COMMON_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&nbsp;", "\xa0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&rsquo;", "’"),
    ("&hellip;", "…"),
    ("&amp;", "&"),
)

# Our own stop-word list for ranking (the design only asks for a fixed one).
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as",
    "at", "be", "been", "but", "by", "can", "could", "did", "do", "does",
    "for", "from", "had", "has", "have", "he", "her", "his", "how", "i", "if",
    "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no",
    "not", "of", "on", "or", "our", "out", "over", "she", "so", "some", "such",
    "than", "that", "the", "their", "them", "then", "there", "these", "they",
    "this", "those", "to", "up", "was", "we", "were", "what", "when", "which",
    "who", "will", "with", "would", "you", "your",
)


@dataclass(frozen=True)
class RankingSettings:
    """Weights and windows of the ranking stage."""

    window_days: int = 7
    title_weight: float = 2.0
    weight_relevance: float = 0.7
    weight_recency: float = 0.3
    weight_credibility: float = 0.2
    halflife_hours: float = 48.0
    top_n: int = 10
    daily_picks: int = 3


@dataclass(frozen=True)
class BatchSettings:
    """Fairness and health rules of a batch ingest run."""

    source_limit: int = 10
    min_fetch_interval_sec: int = 60
    auto_deactivate_after: int = 0


@dataclass(frozen=True)
class SummarySettings:
    """Limits of the summarisation work list."""

    model: str = "default"
    daily_token_budget: int = 50_000
    max_sentences: int = 3
    min_sentences: int = 2


@dataclass(frozen=True)
class NearDuplicateSettings:
    """Shingle length and the exact similarity threshold, in hundredths."""

    shingle_words: int = 5
    percent: int = 80


@dataclass(frozen=True)
class AdjacencySettings:
    """Neighbours of a topic: how many, their least support, and how much terms count."""

    k: int = 10
    min_users: int = 2
    min_terms: int = 2
    term_weight: float = 0.5


@dataclass(frozen=True)
class LearningSettings:
    """Step and bounds of the keyword weight update, and rating smoothing."""

    learning_rate: float = 0.1
    min_weight: float = 0.1
    max_weight: float = 5.0
    prior_up: float = 1.0
    prior_total: float = 2.0
