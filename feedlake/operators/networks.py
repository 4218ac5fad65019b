"""Addresses in networks: block lists of any length, the longest prefix first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import let
from feedlake.functions.urls import ipv4_number, ipv6_hex
from feedlake.session import gathered


def address_digits(host: Column) -> Column:
    """An address literal as hexadecimal digits, 8 of them or 32; null for other hosts."""
    four = let(ipv4_number(host), lambda n: F.when(n.isNotNull(), F.lpad(F.lower(F.hex(n)), 8, "0")))
    return F.coalesce(four, ipv6_hex(host))


def masked(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of an address; a digit that is cut keeps its upper part."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2), 4 - rest).cast("int")
    cut = F.when(rest > 0, F.lower(F.hex((digit - digit % step).cast("long")))).otherwise(F.lit(""))
    return F.concat(F.substring(digits, F.lit(1), whole), cut)


def network_keys(networks: DataFrame, column: str = "network") -> DataFrame:
    """(network, size, bits, key) of a list of "address/bits", an address alone being a
    network of one. Entries that are neither are left out; of entries that name the same
    network the smallest text stays."""
    text = F.lower(F.trim(F.col(column).cast("string")))
    rows = networks.select(
        F.col(column).alias("network"),
        address_digits(F.regexp_extract(text, r"^([0-9a-f.:]+)(?:/\d{1,3})?$", 1)).alias("digits"),
        F.regexp_extract(text, r"/(\d{1,3})$", 1).try_cast("int").alias("given"),
        text.contains("/").alias("sized"),
    ).where("digits is not null")
    size = 4 * F.length("digits")
    rows = rows.withColumn("bits", F.when(F.col("sized"), F.col("given")).otherwise(size)).where(F.col("bits") <= size)
    return rows.groupBy(size.alias("size"), "bits", masked(F.col("digits"), F.col("bits")).alias("key")).agg(
        F.min("network").alias("network")
    )


def longest_network(hosts: DataFrame, networks: DataFrame, host: str = "host", column: str = "network") -> DataFrame:
    """(host, network): of each distinct host that is an address in a network, the one with
    the longest prefix.

    An address has one key for each prefix length in use, 33 or 129 at most, and meets
    the networks by equality on it, so the list may be of any length: no range join, and
    no side is broadcast unless Spark finds it small. Copies of a host are folded first.
    All of this happens where a host was dealt to, in parts whose size does not grow.
    """
    keys = network_keys(networks, column)
    used = keys.select("size", "bits").distinct().collect()
    lengths = {n: sorted(r.bits for r in used if r["size"] == n) for n in (32, 128)}
    known = gathered(hosts.select(F.col(host).alias("host")), "host").distinct()
    known = known.withColumn("digits", address_digits(F.lower("host"))).where("digits is not null")

    def of(size: int) -> Column:
        return F.array(*(F.lit(b) for b in lengths[size])).cast("array<int>")

    size = (4 * F.length("digits")).cast("int")
    bits = F.explode(F.when(size == 32, of(32)).otherwise(of(128)))
    rows = known.withColumn("size", size).select("host", "digits", "size", bits.alias("bits"))
    rows = rows.withColumn("key", masked(F.col("digits"), F.col("bits")))
    met = rows.join(keys, ["size", "bits", "key"])
    return met.groupBy("host").agg(F.max_by("network", "bits").alias("network"))
