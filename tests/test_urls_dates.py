"""Golden cases of URL, address, date and hash functions."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime
from urllib.parse import parse_qs, urlencode, urlsplit

from pyspark.sql import functions as F

from feedlake import config as C
from feedlake.functions import dates, hashing, urls


def test_canonicalize_url(values):
    cases = [
        ("HTTP://Port.Example.ORG/Quay", "http://port.example.org/Quay"),
        (
            "https://tide.example/t?utm_campaign=x&utm_term=y&zone=3",
            "https://tide.example/t?zone=3",
        ),
        ("https://tide.example/t#top", "https://tide.example/t"),
        ("http://tide.example:80/q", "http://tide.example/q"),
        ("https://tide.example:443/q", "https://tide.example/q"),
        ("https://tide.example:80/q", "https://tide.example:80/q"),
        ("https://tide.example/q?n=9&d=4&k=7", "https://tide.example/q?d=4&k=7&n=9"),
        ("https://tide.example/q/", "https://tide.example/q"),
        ("https://tide.example/q//", "https://tide.example/q/"),
        ("https://tide.example/", "https://tide.example/"),
        ("https://tide.example", "https://tide.example"),
        ("//Example.com/p", "https://example.com/p"),
        ("https://e.com/?flag&a=&b=1", "https://e.com/?b=1"),
        ("https://e.com/?b=2&a=1&b=1", "https://e.com/?a=1&b=2&b=1"),
        ("https://e.com/?UTM_Source=x&q=a+b%20c", "https://e.com/?q=a+b+c"),
        ("https://e.com/?q=*~%2F%zz%", "https://e.com/?q=%2A~%2F%25zz%25"),
        ("https://e.com/?q=%C3%A9&%C3%A9=1", "https://e.com/?q=%C3%A9&%C3%A9=1"),
        ("https://User@E.com:443/a b", "https://user@e.com/a b"),
        ("https://e.com/a/;v=1?x=1", "https://e.com/a;v=1?x=1"),
        ("https://e.com/a?x=1?y=2", "https://e.com/a?x=1%3Fy%3D2"),
        ("  https://e.com/a  ", "https://e.com/a"),
        ("https://e.com/a\nb", "https://e.com/ab"),
        ("example.com/p", "example.com/p"),
        ("mailto:a@b.c", "mailto:a@b.c"),
        ("http://[::1/p", "http://[::1/p"),
        ("", ""),
        ("  ", ""),
        (None, ""),
    ]
    got = values(urls.canonicalize_url, [c[0] for c in cases])
    assert got == [c[1] for c in cases]


def test_query_rule_agrees_with_urllib(values):
    rng = random.Random(7)
    alphabet = ["a", "B", "=", "&", "+", "%20", "%", "%C3%A9", "~", "*", "x", "1", "-", "%2B", "/"]
    inputs = [
        "https://e.com/p?" + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
        for _ in range(400)
    ]

    def expected(url):
        params = parse_qs(urlsplit(url).query)
        kept = {k: v for k, v in params.items() if k.lower() not in C.TRACKING_PARAMS}
        query = urlencode(sorted(kept.items()), doseq=True)
        return "https://e.com/p" + ("?" + query if query else "")

    assert values(urls.canonicalize_url, inputs) == [expected(u) for u in inputs]


def test_legacy_url(values):
    cases = [
        ("https://E.com/p/?z=1&ref=x&a=2&z=3#f", "https://e.com/p/?z=1&z=3&a=2"),
        ("https://e.com/p?source=a&mc_cid=1", "https://e.com/p?mc_cid=1"),
        ("/relative", "/relative"),
        (None, ""),
    ]
    got = values(urls.canonicalize_url_legacy, [c[0] for c in cases])
    assert got == [c[1] for c in cases]


def test_url_policy(values):
    cases = [
        ("https://tide.example/rss.xml", None),
        ("http://quay.example.net:8443/atom", None),
        ("https://93.184.216.34/rss", None),
        ("http://localhost:3000/rss", "localhost"),
        ("http://127.8.9.1/rss", "blocked_network"),
        ("http://192.168.77.5/rss", "blocked_network"),
        ("http://10.44.3.2/rss", "blocked_network"),
        ("http://172.20.6.7/rss", "blocked_network"),
        ("http://172.33.0.9/rss", None),
        ("http://169.254.7.7/x", "blocked_network"),
        ("http://[::1]/feed", "blocked_network"),
        ("http://[fd00::1]:80/feed", "blocked_network"),
        ("http://[fe80::1]/", "blocked_network"),
        ("http://[2001:db8::1]/", None),
        ("http://010.0.0.1/", None),
        ("gopher://tide.example/1", "scheme"),
        ("file:///var/log/tide", "scheme"),
        ("javascript:void(0)", "scheme"),
        ("data:text/plain,tide", "scheme"),
        ("low tide", "scheme"),
        ("http://", "no_host"),
        ("https:///quay", "no_host"),
        ("", "empty"),
        (None, "empty"),
    ]
    got = values(urls.url_violation, [c[0] for c in cases])
    assert got == [c[1] for c in cases]


def test_ipv6_expansion_agrees_with_stdlib(values):
    import ipaddress

    hosts = ["::", "::1", "1::", "fe80::1:2", "2001:db8:0:0:0:0:0:1", "0:0:0:0:0:0:0:1",
             "1:2:3:4:5:6:7::", "1:2:3", ":::", "1::2::3", "12345::", "a.b", "1:2:3:4:5:6:7:8:9",
             "1:2:3:4:5:6:7:8", ":1", "1:"]

    def expected(host):
        try:
            return f"{int(ipaddress.IPv6Address(host)):032x}"
        except ValueError:
            return None

    assert values(urls.ipv6_hex, hosts) == [expected(h) for h in hosts]


def test_parse_published(values):
    cases = [
        ("Thu, 09 Nov 2017 21:34:56 GMT", datetime(2017, 11, 9, 21, 34, 56)),
        ("Thu, 09 Nov 2017 21:34:56 -0730", datetime(2017, 11, 10, 5, 4, 56)),
        ("9 Nov 2017 21:34 +0000", datetime(2017, 11, 9, 21, 34)),
        ("Saturday, 7 March 2015 07:08:09 Z", datetime(2015, 3, 7, 7, 8, 9)),
        ("9 Nov 17 21:34:56 GMT", datetime(2017, 11, 9, 21, 34, 56)),
        ("Tue, 09 Nov 99 01:02:03 +0000", datetime(1999, 11, 9, 1, 2, 3)),
        ("09 Nov 68 01:02", datetime(2068, 11, 9, 1, 2)),
        ("2017-11-09T21:34:56Z", datetime(2017, 11, 9, 21, 34, 56)),
        ("2017-11-09T21:34:56+05", datetime(2017, 11, 9, 16, 34, 56)),
        ("2017-11-09T21:34:56.654321+02:00", datetime(2017, 11, 9, 19, 34, 56, 654321)),
        ("2017-11-09T21:34:56.7654321Z", datetime(2017, 11, 9, 21, 34, 56, 765432)),
        ("2017-11-09T21:34:56.500Z", datetime(2017, 11, 9, 21, 34, 56, 500000)),
        ("2017-11-09 21:34:56", datetime(2017, 11, 9, 21, 34, 56)),
        ("2017-11-09", datetime(2017, 11, 9)),
        ("20171109T213456Z", datetime(2017, 11, 9, 21, 34, 56)),
        ("20171109T2134-03", datetime(2017, 11, 10, 0, 34)),
        ("20171109", datetime(2017, 11, 9)),
        ("2017/11/09 21:34:56", datetime(2017, 11, 9, 21, 34, 56)),
        ("Thu Nov  9 21:34:56 2017", datetime(2017, 11, 9, 21, 34, 56)),
        ("11/09/2017", datetime(2017, 11, 9)),
        ("11/9/2017 21:34:56", datetime(2017, 11, 9, 21, 34, 56)),
        ("11/09/2017 9:34 pm", datetime(2017, 11, 9, 21, 34)),
        ("25/11/2017", datetime(2017, 11, 25)),
        ("November 9, 2017 9:34 AM", datetime(2017, 11, 9, 9, 34)),
        ("November 9, 2017 9:05 pm", datetime(2017, 11, 9, 21, 5)),
        ("Nov 9, 2017", datetime(2017, 11, 9)),
        ("09 NOV 2017 21:34:56 EST", datetime(2017, 11, 9, 21, 34, 56)),
        ("no day at all", None),
        ("2017-14-41", None),
        ("13/13/2017", None),
        ("November 2017", None),
        ("9 Nov", None),
        ("2017", None),
        ("", None),
        (None, None),
    ]
    assert values(dates.parse_published, [c[0] for c in cases]) == [c[1] for c in cases]


def test_content_hash(spark):
    rows = [
        ("A Title", "https://e.com/a", datetime(2023, 1, 15, 10), "s" * 150),
        ("a title", "https://e.com/a", datetime(2023, 1, 15, 10), "s" * 100 + "other"),
        ("A Title", "https://e.com/a", datetime(2023, 1, 15, 10, 0, 0, 5), None),
        ("A Title", "https://e.com/a", None, None),
    ]
    df = spark.createDataFrame(rows, "t string, l string, p timestamp, s string")
    got = [
        r.h
        for r in df.select(
            hashing.content_hash(F.col("t"), F.col("l"), F.col("p"), F.col("s")).alias("h")
        ).collect()
    ]

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    fallback = "fallback:" + sha("https://e.com/a")[:8]
    assert got[0] == got[1] == sha(f"a title|https://e.com/a|2023-01-15T10:00:00+00:00|{'s' * 100}")
    assert got[2] == sha("a title|https://e.com/a|2023-01-15T10:00:00.000005+00:00|")
    assert got[3] == sha(f"a title|https://e.com/a|{fallback}|")
