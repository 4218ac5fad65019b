"""WARC archives of web pages: written by Spark tasks, read back record by record.

An archive is a run of gzip members, one for each record. The reader goes through it
in order: bytes are inflated in small steps, the header of a record says how long its
block is, and what the block holds is checked against the digests in the header.
Payloads that occur more than once are kept once, the others are revisit records.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.session import scratch_path

#: An archive is closed when it holds so many bytes; a longer record is one of its own.
ARCHIVE_BYTES = 32 << 20
#: What the reader inflates at a time, and the longest header it accepts.
STEP_BYTES = 1 << 16
HEADER_BYTES = 1 << 20
#: Rows that go to the JVM together have about so many bytes.
BATCH_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_URN = "urn:page:"
_GZIP_START = b"\x1f\x8b\x08"

RECORD_SCHEMA = (
    "archive string, offset long, record_type string, page_id long, refers_to long, url string, "
    "payload_bytes long, payload_digest string, payload binary, problem string"
)


def sha1_base32(data: bytes) -> str:
    """Digest as WARC headers write it, without the ``sha1:`` ahead."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    """One gzip member that ends in a zero byte.

    The last byte is the highest of the inflated length, so it is zero below 16 MB;
    a longer one gets an empty member behind it, which gzip readers pass over.
    """
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(data) + packer.flush()
    return member if member[-1] == 0 else member + gzip_member(b"")


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1F\x7F]+", " ", value).strip()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or with ``refers_to`` a revisit record, as WARC/1.1 bytes.

    A revisit keeps the head of the response, whose Content-Length is the full
    payload's, but not the payload.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{ID_URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", _clean(url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{ID_URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    """What the reader found at ``offset``; ``problem`` says why it can't be trusted."""

    offset: int
    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    problem: str | None = None

    @property
    def head(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[0]

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


class _Member:
    """The inflated bytes of the gzip member at ``start``, in steps."""

    def __init__(self, data: memoryview, start: int):
        self.data, self.at, self.unpacker, self.held = data, start, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflate a step; False at the member's end or the archive's."""
        if self.unpacker.eof:
            return False
        source = self.unpacker.unconsumed_tail or bytes(self.data[self.at : self.at + STEP_BYTES])
        if not self.unpacker.unconsumed_tail:
            self.at += len(source)
        # Without input the inflater may still have output that did not fit in a step.
        step = self.unpacker.decompress(source, STEP_BYTES)
        self.held += step
        return bool(source or step)

    def drain(self) -> None:
        """Go to the member's end without keeping what it holds."""
        while self.more():
            self.held.clear()

    @property
    def end(self) -> int:
        return self.at - len(self.unpacker.unused_data)

    def until(self, mark: bytes, limit: int) -> int:
        """Where ``mark`` first stands in the inflated bytes, or -1."""
        found, seen = self.held.find(mark), 0
        while found < 0 and len(self.held) < limit and self.more():
            found = self.held.find(mark, max(0, seen - len(mark)))
            seen = len(self.held)
        return found

    def fill(self, size: int) -> bool:
        while len(self.held) < size:
            if not self.more():
                return False
        return True


def _parse(member: _Member, found: Record) -> str | None:
    """Fill in ``found`` from a member; what is wrong with it, if anything."""
    stop = member.until(b"\r\n\r\n", HEADER_BYTES)
    if stop < 0:
        return "no header"
    version, *lines = bytes(member.held[:stop]).decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        return "not a WARC record"
    for line in lines:
        name, _, value = line.partition(":")
        found.fields[name.strip().lower()] = value.strip()
    size = found.fields.get("content-length", "")
    if not size.isdecimal():
        return "no length"
    whole = member.fill(stop + 4 + int(size) + 4)
    found.block = bytes(member.held[stop + 4 : stop + 4 + int(size)])
    if not whole:
        return "cut short"
    if bytes(member.held[stop + 4 + int(size) :]) != b"\r\n\r\n":
        return "wrong length"
    while member.more():
        if len(member.held) > stop + 4 + int(size) + 4:
            return "wrong length"
    if not member.unpacker.eof:
        return "cut short"
    digest = found.fields.get("warc-block-digest")
    if digest and digest != f"sha1:{sha1_base32(found.block)}":
        return "block digest differs"
    kind, digest = found.fields.get("warc-type"), found.fields.get("warc-payload-digest")
    if kind == "response" and digest and digest != f"sha1:{sha1_base32(found.payload)}":
        return "payload digest differs"
    return None


def read_records(archive: bytes) -> Iterator[Record]:
    """All records of an archive in order, one at a time.

    A damaged record comes out with its problem; reading goes on at the next place that
    looks like a gzip member. Empty members are passed over.
    """
    data, at = memoryview(archive), 0
    while at < len(data):
        member, found = _Member(data, at), Record(at)
        try:
            found.problem = _parse(member, found)
        except zlib.error:
            found.problem = "not gzip"
        if member.unpacker.eof and found.problem in (None, "no header") and not member.held:
            at = member.end
            continue
        yield found
        if found.problem:
            with contextlib.suppress(zlib.error):
                member.drain()
        if member.unpacker.eof:
            at = max(member.end, at + 1)
        else:
            at = archive.find(_GZIP_START, at + 1)
            if at < 0:
                return


def _batches(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (size, row) pairs, bounded in bytes."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def with_originals(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the greatest id among the rows of the
    same payload, null for rows that have it themselves.

    Payloads are compared by their SHA-256. Only digests and ids are grouped; a payload
    that many rows share is one row when it meets them, so Spark can split those rows.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html")
    ).withColumn("digest", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    greatest = rows.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    shared = greatest.where("n > 1 and original is not null").drop("n")
    found = rows.join(shared, "digest", "left")
    same = F.col("page_id").eqNullSafe(F.col("original"))
    return found.select("page_id", "url", "html", F.when(~same, F.col("original")).alias("refers_to"))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a record per row of ``pages`` below ``path``, in archives of bounded size.

    A null html is an empty payload, a null url leaves out the target, a null id gives a
    record without a number that never is another's original. Rows that repeat the
    greatest id of their payload are responses all. No other column is read.

    Spark's text writer stores the members, so tasks that run again replace their own
    output only, on any store that Spark writes to. It ends each row in a separator:
    the zero byte in which every member ends.
    """
    schema = pa.schema([("archive", pa.int32()), ("member", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple[int, dict]]:
            archive = size = 0
            for batch in batches:
                for row in zip(*(batch.column(k) for k in range(4)), strict=True):
                    page_id, url, html, original = (x.as_py() for x in row)
                    member = gzip_member(record(page_id, url, html.encode(), original))
                    if size and size + len(member) > archive_bytes:
                        archive, size = archive + 1, 0
                    size += len(member)
                    yield len(member), {"archive": archive, "member": member[:-1]}

        return _batches(members(), schema)

    rows = with_originals(pages, id_col, url_col, html_col)
    packed = rows.mapInArrow(pack, "archive int, member binary")
    # A cast to string keeps the bytes as they are.
    files = packed.select("archive", F.col("member").cast("string").alias("value"))
    files.write.partitionBy("archive").option("lineSep", "\x00").mode("overwrite").text(path)


def _number(value: str | None) -> int | None:
    digits = (value or "").strip("<>").removeprefix(ID_URN)
    return int(digits) if re.fullmatch(r"-?\d+", digits) else None


def _row(archive: str, found: Record, payloads: bool) -> dict:
    """A Record as a row; the payload's length and digest are the full payload's."""
    get = found.fields.get
    length = re.search(rb"(?im)^content-length:\s*(\d+)", found.head)
    kept = get("warc-type") == "response" and found.problem is None
    return {
        "archive": archive,
        "offset": found.offset,
        "record_type": get("warc-type"),
        "page_id": _number(get("warc-record-id")),
        "refers_to": _number(get("warc-refers-to")),
        "url": get("warc-target-uri"),
        "payload_bytes": len(found.payload) if kept else int(length[1]) if length else None,
        "payload_digest": get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload": found.payload if kept and payloads else None,
        "problem": found.problem,
    }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of all archives below ``path`` (RECORD_SCHEMA).

    Archives are read by Spark, so they may be in any store it knows; one task reads an
    archive from its first record to its last. Damaged records have a ``problem`` and no
    payload. A revisit's length comes from the head it keeps. A folder without archives
    gives an empty table.
    """
    schema = pa.schema(
        [
            ("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()),
            ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("payload", pa.binary()), ("problem", pa.string()),
        ]
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, dict]]:
            for batch in batches:
                for name, content in zip(batch.column(0), batch.column(1), strict=True):
                    for found in read_records(content.as_py()):
                        yield 200 + len(found.block), _row(name.as_py(), found, payloads)

        return _batches(rows(), schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(unpack, RECORD_SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, and read them (see there)."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    return read_archives(spark, path, payloads=False)
