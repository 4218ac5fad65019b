"""URL canonicalisation and URL policy as Column expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions.text import let, strip_whitespace

# Generic URI syntax: scheme, authority, path, query; the fragment is dropped.
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?.*$"
_SEP = "\x01"


def split_url(url: Column) -> Column:
    """Array of scheme, authority, path and query; empty when absent."""
    joined = F.regexp_replace(url, _SPLIT, _SEP.join(f"${i}" for i in range(1, 5)))
    return F.split(joined, _SEP, -1)


def _unquote(part: Column) -> Column:
    """Decode a query part; a lone "%" stands for itself."""
    return F.coalesce(
        F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25")),
        F.translate(part, "+", " "),
    )


def _quote(part: Column) -> Column:
    encoded = F.url_encode(part)
    return F.replace(
        F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def _query_pairs(query: Column) -> Column:
    """Decoded (name, index, value) of each pair; blank values are dropped."""
    tokens = F.filter(F.split(query, "&", -1), lambda t: t.rlike("(?s)=."))
    return F.transform(
        tokens,
        lambda t, i: F.struct(
            _unquote(F.substring_index(t, "=", 1)).alias("name"),
            i.alias("index"),
            _unquote(F.regexp_replace(t, "(?s)^[^=]*=", "")).alias("value"),
        ),
    )


def clean_query(query: Column, tracking: Iterable[str], by_name: bool = True) -> Column:
    """Drop tracking parameters, group repeated names and encode again.

    ``by_name`` sorts names; otherwise names keep the order they appear in.
    """
    kept = F.filter(
        _query_pairs(query), lambda p: ~F.lower(p["name"]).isin(*[t.lower() for t in tracking])
    )
    if by_name:
        ordered = F.array_sort(kept)
    else:
        ordered = let(
            kept,
            lambda pairs: F.array_sort(
                F.transform(
                    pairs,
                    lambda p: F.struct(
                        F.array_position(
                            F.transform(pairs, lambda q: q["name"]), p["name"]
                        ).alias("first"),
                        p["index"].alias("index"),
                        p["name"].alias("name"),
                        p["value"].alias("value"),
                    ),
                )
            ),
        )
    encoded = F.transform(
        ordered, lambda p: F.concat(_quote(p["name"]), F.lit("="), _quote(p["value"]))
    )
    return F.array_join(encoded, "&")


def _with_query(base: Column, query: Column) -> Column:
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def canonicalize_url(url: Column) -> Column:
    """One spelling per address.

    Lower-case scheme and authority, no default port, no tracking parameters,
    sorted query, no fragment, one trailing slash less. A link without an
    authority comes back trimmed but otherwise unchanged.
    """
    trimmed = F.translate(strip_whitespace(url), "\t\r\n", "")

    def rebuild(parts: Column) -> Column:
        scheme = F.lower(
            F.when(F.get(parts, F.lit(0)) == "", F.lit("https")).otherwise(F.get(parts, F.lit(0)))
        )
        origin = F.concat(scheme, F.lit("://"), F.lower(F.get(parts, F.lit(1))))
        origin = F.regexp_replace(origin, r"^(http://.*):80$|^(https://.*):443$", "$1$2")
        path = F.regexp_replace(F.get(parts, F.lit(2)), "(?s)^(.+)/(;[^/]+)?$", "$1$2")
        query = F.when(F.get(parts, F.lit(3)) == "", F.lit("")).otherwise(
            clean_query(F.get(parts, F.lit(3)), C.TRACKING_PARAMS)
        )
        return _with_query(F.concat(origin, path), query)

    result = let(
        trimmed,
        lambda text: let(
            split_url(text),
            lambda parts: F.when(
                (F.get(parts, F.lit(1)) == "") | ~_balanced_brackets(F.get(parts, F.lit(1))), text
            ).otherwise(rebuild(parts)),
        ),
    )
    return F.coalesce(result, F.lit(""))


def _balanced_brackets(authority: Column) -> Column:
    return authority.contains("[") == authority.contains("]")


def canonicalize_url_legacy(url: Column) -> Column:
    """Legacy profile: longer tracking list, query order kept, path untouched."""

    def rebuild(parts: Column) -> Column:
        scheme, authority = F.lower(F.get(parts, F.lit(0))), F.lower(F.get(parts, F.lit(1)))
        base = F.concat(
            F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":"))),
            F.when(authority == "", F.lit("")).otherwise(F.concat(F.lit("//"), authority)),
            F.get(parts, F.lit(2)),
        )
        query = F.when(F.get(parts, F.lit(3)) == "", F.lit("")).otherwise(
            clean_query(F.get(parts, F.lit(3)), C.LEGACY_TRACKING_PARAMS, by_name=False)
        )
        return _with_query(base, query)

    return F.coalesce(let(split_url(url), rebuild), F.lit(""))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_host(url: Column) -> Column:
    """Lower-case host without user info, port and brackets; empty if absent."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    no_user = F.regexp_replace(authority, "^.*@", "")
    return F.lower(F.regexp_replace(no_user, r"^\[([^\]]*)\].*$|:[^:\]]*$", "$1"))


# --- Address literals -------------------------------------------------------

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_number(host: Column) -> Column:
    """The address as a number, or null when ``host`` is no IPv4 literal."""
    value = sum(
        (
            F.try_to_number(F.nullif(F.regexp_extract(host, _IPV4, i), F.lit("")), F.lit("999"))
            .cast("long")
            * F.lit(256 ** (4 - i))
            for i in range(1, 5)
        ),
        F.lit(0).cast("long"),
    )
    return value


def ipv6_hex(host: Column) -> Column:
    """The address as 32 hex digits, or null when ``host`` is no IPv6 literal."""

    def groups(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def expand(halves: Column) -> Column:
        left = groups(F.get(halves, F.lit(0)))
        right = groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        missing = F.lit(8) - F.size(left) - F.size(right)
        valid = F.when(F.size(halves) == 1, missing == 0).otherwise(missing > 0)
        filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        return F.when(valid, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))

    well_formed = host.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & ~host.rlike(
        "[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$"
    )
    return F.when(well_formed, let(F.split(host, "::", -1), expand))


def blocked_network(host: Column, networks: Iterable[str] = C.BLOCKED_NETWORKS) -> Column:
    """The first blocked network holding ``host``, or null.

    The list is a setting of a few entries, so it becomes a CASE expression:
    the test is part of the scan and needs no join.
    """
    parsed = [ipaddress.ip_network(n, strict=False) for n in networks]

    def first_match(v4: Column, v6: Column) -> Column:
        result = None
        for net in parsed:
            low, high = int(net.network_address), int(net.broadcast_address)
            if net.version == 4:
                inside = v4.between(low, high)
            else:
                inside = v6.between(f"{low:032x}", f"{high:032x}")
            name = F.lit(str(net))
            result = F.when(inside, name) if result is None else result.when(inside, name)
        return F.lit(None).cast("string") if result is None else result

    return let(
        F.struct(ipv4_number(host).alias("v4"), ipv6_hex(host).alias("v6")),
        lambda ip: first_match(ip["v4"], ip["v6"]),
    )


def url_violation(url: Column) -> Column:
    """Why a feed address must not be fetched, or null when it may be."""
    host = url_host(url)
    return (
        F.when(url.isNull() | (url == ""), F.lit("empty"))
        .when(~url_scheme(url).isin(*C.ALLOWED_URL_SCHEMES), F.lit("scheme"))
        .when(host == "", F.lit("no_host"))
        .when(blocked_network(host).isNotNull(), F.lit("blocked_network"))
        .when(host.isin("localhost", "127.0.0.1", "::1"), F.lit("localhost"))
    )
