"""WARC archives: a writer, and a reader that salvages damaged archives.

The writer turns a table of pages into WARC/1.1 records, a ``revisit`` where a
page with a smaller id has the same payload.  Records are text that ends in two
line ends, so Spark's text sink writes them as they are, to any file system.

The reader takes archives through Spark's binary source, plain or in gzip
members.  It checks every record (framing, length, digests); after a failed
check it searches for the next member or version line that begins a record
which passes them, goes on there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import prepare, stored

#: Records and bytes of one archive, which the reader holds in a task.  Pages
#: go to archives by size class, with as many records as the bytes allow, so
#: only a single page of more bytes makes a larger archive.
RECORDS, BYTES = 2048, 1 << 28
#: Each size class has pages this many times as long as the one before.
CLASS = 16
#: Bytes that are inflated at a time.
SLICE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"

FOUND = ("path string, kind string, start long, stop long, type string, record_id string, refers_to string, uri string, "
         "date string, content_type string, payload_digest string, payload_bytes long, payload binary, reason string")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case Base32 of the SHA-1 of binary data."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _classes(longest: int, records: int, size: int) -> list[tuple[int, int, int]]:
    """(least bytes, most bytes, records of an archive) of the size classes of
    pages up to ``longest`` bytes."""
    out, low, n = [], 0, records
    while True:
        high = max(1, size // n)
        out.append((low, high, n))
        if longest < high or n == 1:
            out[-1] = (low, max(high, longest + 1), n)
            return out
        low, n = high, max(1, n // CLASS)


def write_pages(pages: DataFrame, path: str, least: int = 0, date: str = DATE, records: int = RECORDS, size: int = BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``,
    in archives of ``records`` records and about ``size`` bytes at most.

    Of pages with equal payloads of at least ``least`` bytes the one with the
    smallest id is a response, the others revisit it; pages without an id, or
    repeating the smallest one, of payloads met once are responses too.  Null
    html is an empty payload, a null url is left out, control characters in a
    url become ``%20``.  An empty table writes no record."""
    prepare(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit(""))
    digest = base32_sha1(body.cast("binary"))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    some = plain.select("page_id", base32_sha1(F.col("html").cast("binary")).alias("d")).where(F.octet_length("html") >= least)
    firsts = stored(some.groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"), "firsts")
    again = stored(some.join(firsts, "d").where("not page_id <=> first").select(F.col("page_id").alias("_p"), F.col("d").alias("_d"), "first").distinct(), "again")
    x = plain.withColumn("d", digest).join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("d") == F.col("_d")), "left")
    seen = F.col("_d").isNotNull()
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=UTF-8\r\nContent-Length: "),
                     F.octet_length("html").cast("string"), F.lit(END), F.when(seen, F.lit("")).otherwise(F.col("html")))
    x = x.withColumn("block", block)
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(seen, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))), _line("WARC-Date", date),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        F.when(seen, F.concat(_line("WARC-Refers-To", _urn(F.col("first"))), _line("WARC-Profile", PROFILE))).otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "d")),
        _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block").cast("binary")))),
        _line("Content-Type", "application/http;msgtype=response"),
        _line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"))
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    for low, high, n in _classes(longest, records, size):   # one for pages of usual length
        part = x.where((F.octet_length("html") >= low) & (F.octet_length("html") < high))
        part.select(F.concat(head, "block").alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", n).text(path)


class Damaged(Exception):
    """A record or member that fails a check."""


@dataclass
class Record:
    start: int
    stop: int
    head: dict[str, str]
    block: bytes


def _head(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if line and not colon:
            raise Damaged("header line without a colon")
        if line:
            out[name.strip().lower()] = value.strip()
    return out


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_at(data: bytes, at: int) -> Record:
    """The record that begins at ``at``, if it passes every check."""
    if not (version := VERSION.match(data, at)):
        raise Damaged("no version line")
    if (body := data.find(b"\r\n\r\n", version.end() - 2)) < 0:
        raise Damaged("headers without an end")
    head = _head(data[version.end():body])
    if not (size := head.get("content-length", "")).isdigit():
        raise Damaged("no content length")
    body += 4
    stop = body + int(size)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Damaged("no line ends after the block")
    block = data[body:stop]
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != _sha1(block):
        raise Damaged("block digest differs")
    return Record(at, stop + 4, head, block)


def payload(r: Record) -> tuple[bytes | None, int | None, str | None]:
    """A record's payload, its length and its digest; those of a revisit are
    the full payload's, which it does not hold."""
    body, size = r.block, None
    if r.head.get("content-type", "").startswith("application/http"):
        http, _, body = r.block.partition(b"\r\n\r\n")
        size = _head(http.partition(b"\r\n")[2]).get("content-length", "")
    digest = r.head.get("warc-payload-digest", "")
    digest = digest[5:] if digest.startswith("sha1:") else None
    if r.head.get("warc-type") == "revisit":
        return None, int(size) if size and size.isdigit() else None, digest
    if digest and digest != _sha1(body):
        raise Damaged("payload digest differs")
    return body, len(body), digest or _sha1(body)


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """A gzip member's content and its end; read slice by slice, so a member
    costs its own length wherever it stands."""
    inflate, view, out = zlib.decompressobj(31), memoryview(data), []
    try:
        while at < len(data) and not inflate.eof:
            part = view[at:at + SLICE]
            out.append(inflate.decompress(part))
            at += len(part)
    except zlib.error as e:
        raise Damaged(f"gzip member: {e}") from None
    if not inflate.eof:
        raise Damaged("gzip member without an end")
    return b"".join(out), at - len(inflate.unused_data)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """An archive's records, ("record", start, stop, Record), and the gaps
    between them, ("gap", start, stop, reason).  Bytes are those of the file;
    all records of a gzip member have the member's."""
    at, bad, reason = 0, -1, ""
    version = member = -1   # the next places, each searched for once
    while at < len(data):
        try:
            if data[at:at + 3] == MEMBER:
                inner, stop = _member(data, at)
                found = [x for x in salvage(inner)]
                if not any(kind == "record" for kind, *_ in found):
                    raise Damaged("gzip member without a record")
            else:
                r = record_at(data, at)
                payload(r)
                found, stop = [("record", at, r.stop, r)], r.stop
        except Damaged as e:
            if bad < 0:
                bad, reason = at, str(e)
            if version <= at:
                version = found.start() if (found := VERSION.search(data, at + 1)) else len(data)
            if member <= at:
                member = place if (place := data.find(MEMBER, at + 1)) >= 0 else len(data)
            at = min(version, member)
            continue
        if bad >= 0:
            yield "gap", bad, at, reason
            bad = -1
        for kind, _, _, what in found:
            yield kind, at, stop, what
        at = stop
    if bad >= 0:
        yield "gap", bad, len(data), reason


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives below ``path`` (columns of ``FOUND``).

    kind is ``record`` or ``gap``; a gap has the byte range that is quarantined
    and the reason, and null in the columns of a record.  payload is null for
    revisits, and for all if ``payloads`` is false.  An empty file has neither."""
    prepare(spark)
    names = [x.split()[0] for x in FOUND.split(", ")]

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        for kind, start, stop, x in salvage(data):
            if kind == "gap":
                yield name, kind, start, stop, None, None, None, None, None, None, None, None, None, x
            else:
                body, size, digest = payload(x)
                h = x.head.get
                yield (name, kind, start, stop, h("warc-type"), h("warc-record-id"), h("warc-refers-to"), h("warc-target-uri"), h("warc-date"),
                       h("content-type"), digest, size, body if payloads else None, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            return out.astype({"start": "Int64", "stop": "Int64", "payload_bytes": "Int64"})

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                held, size = [], 0
                for row in rows(name, bytes(data)):
                    held.append(row)
                    size += len(row[-2] or b"")
                    if len(held) >= 1000 or size > 1 << 23:
                        yield frame(held)
                        held, size = [], 0
                if held:
                    yield frame(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, FOUND)


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
