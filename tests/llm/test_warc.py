"""Archives: exact round trips, other readers' view, damage."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import os
import random

import pytest

from feedlake.llm import warc as m


def rows_of(found):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)


def plain(pages):
    last = {}
    for i, html in pages:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    out = []
    for i, html in pages:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        original = last.get(html or "")
        first = original is None or i == original
        out.append((i, len(data), digest, "response" if first else "revisit", None if first else original, None))
    return sorted(out, key=str)


PAGES = [
    (1, "<p>one</p>"), (2, "<p>two</p>"), (3, "<p>one</p>"), (4, None), (5, ""), (6, "é\r\n\r\nWARC/1.1\r\n\x00日本"), (7, "<p>one</p>"),
    (7, "<p>one</p>"), (8, "x" * 300_000), (None, "<p>two</p>"), (None, "nameless"), (None, "nameless"), (-9, "minus"),
]


def frame(spark, pages):
    rows = [(i, f"https://e.org/{i}\r\nX: y", h, "r", 5) for i, h in pages]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, archive int")


def test_round_trip(spark):
    pages = PAGES + [(k, f"copy {k % 3}") for k in range(100, 400)]
    assert rows_of(m.round_trip(frame(spark, pages).repartition(3))) == plain(pages)
    assert m.round_trip(frame(spark, pages).where("false")).count() == 0


def test_payloads_urls_and_archive_sizes(spark, tmp_path):
    rng = random.Random(1)
    pages = [(k, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(4000))) for k in range(60)] + [(99, "z")]
    path = str(tmp_path / "w")
    m.write_archives(frame(spark, pages).coalesce(1), path, archive_bytes=30_000)
    files = glob.glob(f"{path}/*/part-*")
    assert len(files) > 10 and max(map(os.path.getsize, files)) < 40_000
    read = m.read_archives(spark, path).collect()
    assert {r.page_id: r.payload.decode() for r in read} == dict(pages)
    assert {r.url for r in read} == {f"https://e.org/{i} X: y" for i, _ in pages}
    # Any gzip reader sees the records one after another.
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: response\r\n") == len(pages)
    # A member starts at each offset.
    for r in read[:5]:
        with open(r.archive.removeprefix("file:"), "rb") as f:
            assert f.read()[r.offset :].startswith(b"\x1f\x8b")


def test_long_records_end_in_an_empty_member():
    data = m.record(1, None, os.urandom(1 << 10) * (17 << 10))
    packed = m.gzip_member(data)
    assert packed[-1] == 0 and gzip.decompress(packed) == data
    found = list(m.read_records(packed + m.gzip_member(m.record(2, "u", b"x"))))
    assert [(r.problem, len(r.payload)) for r in found] == [(None, 17 << 20), (None, 1)]


def damaged(kind):
    one, two, three = (m.record(k, "u", f"payload {k}".encode() * 30) for k in (1, 2, 3))
    if kind == "cut":
        return m.gzip_member(one) + m.gzip_member(two)[:-20], ["cut short"]
    if kind == "bits":
        bad = bytearray(m.gzip_member(two))
        bad[len(bad) // 2] ^= 0xFF
        return m.gzip_member(one) + bytes(bad) + m.gzip_member(three), None
    change = {
        "payload": (b"payload 2payload 2", b"payload 2payload 9", "block digest differs"),
        "length": (b"Content-Length: 3", b"Content-Length: 2", "wrong length"),
        "longer": (b"Content-Length: 3", b"Content-Length: 9", "cut short"),
        "none": (b"Content-Length", b"Content-Lengtx", "no length"),
        "kind": (b"WARC/1.1", b"HTTP/1.1", "not a WARC record"),
        "header": (b"\r\n\r\n", b"\r\n \n", "no header"),
    }[kind]
    head, *rest = two.partition(b"WARC-Payload-Digest")
    bad = two.replace(change[0], change[1]) if kind != "length" and kind != "longer" else head + b"".join(rest).replace(change[0], change[1], 1)
    return m.gzip_member(one) + m.gzip_member(bad) + m.gzip_member(three), [change[2]]


@pytest.mark.parametrize("kind", ["cut", "bits", "payload", "length", "longer", "none", "kind", "header"])
def test_damage_is_told_and_reading_goes_on(kind):
    archive, problems = damaged(kind)
    found = list(m.read_records(archive))
    assert found[0].problem is None
    assert problems is None or [r.problem for r in found if r.problem] == problems
    assert any(r.problem for r in found)
    if kind != "cut":
        assert found[-1].problem is None and found[-1].payload.startswith(b"payload 3")


def test_revisit_keeps_length_and_digest():
    (found,) = m.read_records(m.gzip_member(m.record(4, "u", b"twelve bytes", refers_to=9)))
    row = m._row("a", found, True)
    assert (row["record_type"], row["payload_bytes"], row["refers_to"], row["payload"]) == ("revisit", 12, 9, None)
    assert row["payload_digest"] == m.sha1_base32(b"twelve bytes")
    assert list(m.read_records(b"")) == [] and [r.problem for r in m.read_records(b"no gzip at all")] == ["not gzip"]
