"""WARC archives: a writer made of DataFrame functions, and a salvage reader.

Writing. Every row is a record; equal payloads of at least ``REVISIT_BYTES`` bytes are
stored once, by the row with the largest id, and the others are revisit records that
refer to it. Records go through Spark's text writer with the record terminator as line
separator, so archives land in any file system Spark knows. Records of like size share
files, and ``FILE_BYTES`` bounds a file, which the reader holds whole (a larger record
has a file of its own). Record ids are random UUIDs; the page's id has a header.

Reading. A record must have a version line, a header block, a whole block of the length
it states, the terminator, and a payload of the digest it states. Where a check fails,
the reader looks for the next version line, or the next gzip member that opens, from
which a record passes all checks; what lies between is logged as a quarantined gap.
Plain files and files of one gzip member for each record are both read. What was sought
ahead is kept, and members are fed to the decoder in small windows, so the time is linear
in the bytes, gaps or not.

Input cases. Null html counts as an empty payload; a null id makes a response without an
id; rows that repeat id and payload are alike: all responses, or all revisits. Empty
table: no records. Line breaks in a URL are written as %0D and %0A.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import bitmap, in_bitmap, shared_dir, table, written

REVISIT_BYTES = 1000
#: a file has so many bytes at most, and so many records of the smallest kind
FILE_BYTES, RECORDS_EACH = 1 << 27, 2000
#: bytes of a gzip member that are decoded at once, at first and at most: most signs that begin no member fail early
WINDOW = 1 << 9, 1 << 16
#: a member from whose first bytes nothing comes is none: its header would have no end
HEADER = 1 << 13
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: bits of the filter that knows revisits, 8 MiB
BITS = 1 << 26
END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[0-9]\r?\n")
MEMBER = b"\x1f\x8b\x08"
URN = "urn:page:"


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    start: int
    end: int
    why: str


class _Bad(Exception):
    pass


class _Ahead:
    """The next version line and the next gzip member from a place on; each byte is looked at once."""

    def __init__(self, data: bytes):
        self.data, self.line, self.member = data, -1, -1

    def version(self, at: int) -> int:
        if self.line < at:
            m = VERSION.search(self.data, at)
            self.line = m.start() if m else len(self.data)
        return self.line

    def start(self, at: int) -> int:
        if self.member < at:
            p = self.data.find(MEMBER, at)
            self.member = p if p >= 0 else len(self.data)
        return min(self.version(at), self.member)


def parse(data: bytes, at: int, ahead: _Ahead | None = None) -> Record:
    """The record that begins at ``at``, after all checks."""
    m = VERSION.match(data, at)
    if not m:
        raise _Bad("no version line")
    # headers end before the next version line
    most = (ahead or _Ahead(data)).version(m.end())
    stop = data.find(END, m.end() - 2, most)
    if stop < 0:
        raise _Bad("no end of headers" if most == len(data) else "a version line in the headers")
    headers = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        if line:
            name, colon, value = line.partition(b":")
            if not colon:
                raise _Bad("a header without a colon")
            headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit() or len(size) > 18:
        raise _Bad("no length")
    begin = stop + 4
    end = begin + int(size)
    if data[end : end + 4] != END:
        raise _Bad("no terminator")
    payload = data[begin:end]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and digest.startswith("sha1:") and hashlib.sha1(payload).hexdigest() != digest[5:].lower():
        raise _Bad("wrong digest")
    return Record(at, end + 4, headers, payload)


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at ``at`` holds, and where it ends."""
    d, out, view, fed, (step, most) = zlib.decompressobj(31), [], memoryview(data), 0, WINDOW
    while not d.eof and at < len(data):
        try:
            out.append(d.decompress(view[at : at + step]))
        except zlib.error as e:
            raise _Bad("broken member") from e
        at, fed, step = at + step, fed + step, min(2 * step, most)
        if fed > HEADER and not d.eof and not any(out):
            raise _Bad("no member")
    if not d.eof:
        raise _Bad("member without end")
    return b"".join(out), min(at, len(data)) - len(d.unused_data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The records of an archive and the gaps between them, in order."""
    at, lost, why, ahead = 0, -1, "", _Ahead(data)
    while at < len(data):
        try:
            if data.startswith(MEMBER, at):
                inside, end = _member(data, at)
                found = []
                for r in salvage(inside):
                    found.append(Record(at, end, r.headers, r.payload) if isinstance(r, Record) else Gap(at, end, f"in a member: {r.why}"))
            else:
                r = parse(data, at, ahead)
                found, end = [r], r.end
        except _Bad as e:
            if lost < 0:
                lost, why = at, str(e)
            at = ahead.start(at + 1)
            continue
        if lost >= 0:
            yield Gap(lost, at, why)
            lost = -1
        yield from found
        at = end
    if lost >= 0:
        yield Gap(lost, len(data), why)


def records(pages: DataFrame, date: str | None = None) -> DataFrame:
    """page_id, kind, record (a string), size (as many bytes at least) for every row of ``pages`` (page_id, url, html). ``date``: of the records, as 2024-01-31T00:00:00Z; now if none."""
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    seen = pages.select("page_id", url.alias("url"), F.sha2(html, 256).alias("sha"), F.octet_length(html).alias("n")).where(F.col("n") >= REVISIT_BYTES)
    seen = written(seen, "digests")
    first = seen.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_url"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = seen.drop("url").join(first, "sha").where("page_id <> refers_to").select("page_id", "sha", "refers_to", "refers_url").distinct()
    # a row that the bitmap of revisits doesn't know is a response, and its payload never travels
    place = F.pmod(F.xxhash64("page_id", "sha"), F.lit(BITS))
    again = written(again, "revisits")
    maybe = in_bitmap(bitmap(again.select(place), BITS), pages.sparkSession)
    own = pages.select("page_id", url.alias("url"), html.alias("html"), _size().alias("size")).withColumn("sha", F.sha2("html", 256)).withColumn("maybe", maybe(place))
    sure = own.where("not maybe").withColumn("refers_to", F.lit(None).cast("bigint")).withColumn("refers_url", F.lit(None).cast("string"))
    both = own.where("maybe").join(again, ["page_id", "sha"], "left").unionByName(sure)
    revisit = F.col("refers_to").isNotNull()
    n = F.octet_length("html").cast("string")
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"),
        F.uuid(),
        F.lit(">\r\nWARC-Date: "),
        when,
        F.lit("\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.sha1("html"),
        F.lit("\r\nX-Payload-Length: "),
        n,
        F.coalesce(F.concat(F.lit("\r\nX-Page-ID: "), F.col("page_id").cast("string")), F.lit("")),
        F.when(
            revisit,
            F.concat(
                F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To-Target-URI: "), F.col("refers_url"), F.lit("\r\nWARC-Refers-To-Date: "), when,
                F.lit("\r\nX-Refers-To-Page-ID: "), F.col("refers_to").cast("string"),
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(revisit, "0").otherwise(n),
        F.lit("\r\n\r\n"),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    return both.select("page_id", F.when(revisit, "revisit").otherwise("response").alias("kind"), record.alias("record"), "size")


def _size():
    """At least the bytes of a row's record."""
    return F.coalesce(F.octet_length("html"), F.lit(0)) + 6 * F.coalesce(F.octet_length("url"), F.lit(0)) + 2048


def classes(most: int = FILE_BYTES, each: int = RECORDS_EACH) -> list[tuple[int, int, int]]:
    """(least size, size not reached, records of a file): records of like size share files."""
    out, low = [], 0
    while each:
        out.append((low, most // each if each > 1 else 1 << 62, each))
        low, each = most // each, each // 16 if each > 16 else int(each > 1)
    return out


def write(pages: DataFrame, path: str, date: str | None = None) -> str:
    """The archives of ``pages`` as files in ``path``."""
    inside = lambda low, high: (F.col("size") >= low) & (F.col("size") < high)
    counts = pages.select(_size().alias("size")).agg(*[F.count_if(inside(low, high)).alias(str(low)) for low, high, _ in classes()]).first()
    rows = records(pages, date)
    for n, (low, high, each) in zip(counts, classes(), strict=True):
        if n:
            out = rows.where(inside(low, high)).select(F.col("record").alias("value"))
            out.write.mode("append").option("lineSep", END.decode()).option("maxRecordsPerFile", each).text(path)
    return path


def _page(number: str | None, urn: str | None) -> int | None:
    """A page's id: by its own header, or by a record id of ``URN`` as other archives may have."""
    m = re.fullmatch(r"(-?[0-9]{1,19})", number or "") or re.fullmatch(rf"<?{URN}(-?[0-9]{{1,19}})>?", urn or "")
    return int(m[1]) if m else None


FIELDS = pa.schema(
    [
        ("file", pa.string()),
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("gap", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record, and for each gap (``gap`` says why; no record's columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                rows, held = [], 0
                for r in salvage(data.as_py() or b""):
                    if isinstance(r, Gap):
                        rows.append({"file": name.as_py(), "start": r.start, "stop": r.end, "gap": r.why})
                        continue
                    h = r.headers
                    kind = h.get("warc-type")
                    full = kind != "revisit"
                    length, digest = h.get("x-payload-length", ""), h.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append(
                        {
                            "file": name.as_py(),
                            "start": r.start,
                            "stop": r.end,
                            "page_id": _page(h.get("x-page-id"), h.get("warc-record-id")),
                            "url": h.get("warc-target-uri"),
                            "record_type": kind,
                            "refers_to": _page(h.get("x-refers-to-page-id"), h.get("warc-refers-to")),
                            "payload_bytes": len(r.payload) if full else int(length) if length.isdigit() else None,
                            "payload_digest": hashlib.sha1(r.payload).hexdigest() if full else digest or None,
                            "payload": r.payload if payloads and full else None,
                        }
                    )
                    held += len(r.payload) if payloads else 0
                    if held > 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, FIELDS)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, FIELDS)

    kinds = "file string, start bigint, stop bigint, gap string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, kinds)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page. Archives of our own have no gaps: one fails the query rather than lose records unseen."""
    path = write(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/archives")
    found = read(spark, path, payloads=False)
    broken = F.raise_error(F.concat(F.lit("a gap in "), "file", F.lit(" at "), F.col("start").cast("string"), F.lit(": "), "gap")).cast("bigint")
    page = F.when(F.col("gap").isNull(), F.col("page_id")).otherwise(broken).alias("page_id")
    return found.select(page, "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
      FROM pages)
"""
