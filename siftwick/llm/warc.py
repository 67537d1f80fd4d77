"""Legacy archives: write and parse ARC, convert it to WARC, read WARC back."""

from __future__ import annotations

import hashlib
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, passing, remove, small_batches, written

#: A file ends after so many rows, each of so many packed bytes or one record.
FILE = (32, 1 << 20)
#: Bytes that are unpacked at a time, and the longest header line.
STEP, LONGEST_LINE = 16 << 10, 1 << 20
LEAST_REVISIT = 100
#: Marks (some 200 bytes each) that a broadcast may hold.
MARKS_SENT = 200_000
# Header line formats of the two ARC versions, and a WARC profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "19700101000000"
PAGE_HEADER = "X-Page-Id"


class ArchiveError(ValueError):
    """Bytes that do not follow the archive's format."""


# bytes of files


def member(data: bytes) -> bytes:
    """A gzip member of its own, so that a record can be read from where it begins."""
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


#: Spark's text writer ends each row with the same bytes; an empty member is nothing when unpacked.
NOTHING = member(b"")


def unpacked(data: bytes) -> Iterator[bytes]:
    """The bytes of a file a piece at a time, whether it is packed in gzip members or plain."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(view), STEP):
            yield bytes(view[at : at + STEP])
        return
    while at < len(view):
        d = zlib.decompressobj(31)
        while not d.eof:
            part = view[at : at + STEP]
            if not len(part):
                raise ArchiveError("the last gzip member is cut short")
            try:
                out = d.decompress(part)
            except zlib.error as e:
                raise ArchiveError(f"no gzip member at packed byte {at}: {e}") from e
            at += len(part) - len(d.unused_data)
            if out:
                yield out


class Reader:
    """Lines and counted bytes from the pieces of a file; holds one record, not the file."""

    def __init__(self, data: bytes):
        self.pieces, self.held, self.at, self.offset = unpacked(data), bytearray(), 0, 0

    def _hold(self, n: int) -> bool:
        """Have n bytes ahead, if there are as many."""
        while len(self.held) - self.at < n:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            if self.at > 1 << 20:
                del self.held[: self.at]
                self.at = 0
            self.held += piece
        return True

    def done(self) -> bool:
        return not self._hold(1)

    def take(self, n: int) -> bytes:
        if not self._hold(n):
            raise ArchiveError(f"the file ends before byte {self.offset + n}")
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        self.offset += n
        return out

    def through(self, end: bytes) -> bytes:
        """What comes before ``end``, which is read too."""
        ahead = 0
        while (found := self.held.find(end, self.at + ahead)) < 0:
            ahead = max(0, len(self.held) - self.at - len(end))
            if ahead > LONGEST_LINE or not self._hold(len(self.held) - self.at + 1):
                raise ArchiveError(f"header at byte {self.offset} does not end")
        return self.take(found + len(end) - self.at)[: -len(end)]


def in_rows(records: Iterator[bytes], head: Callable[[int], bytes], file: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Members of records as rows for ``write_rows``; each file begins with a head."""
    rows, row_bytes = file
    held: list[bytes] = []
    size = n = 0
    for r in records:
        if not held and n % rows == 0:
            held.append(member(head(n)))
        held.append(member(r))
        size += len(held[-1])
        if size >= row_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
            held, size, n = [], 0, n + 1
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])


def write_rows(values: DataFrame, path: str, file: tuple[int, int]) -> None:
    """Rows of members as files; Spark's text writer puts out their bytes and an empty member after each."""
    out = values.select(F.col("value").cast("string").alias("value")).write.mode("append")
    out.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", file[0]).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below a path, packed as it is: of the files made here about as many bytes as FILE says."""
    small_batches(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


# ARC


@dataclass
class ArcRecord:
    offset: int
    version: int
    url: str
    ip: str
    date: str
    mime: str
    content: bytes

    @property
    def describes(self) -> bool:
        return self.url.startswith("filedesc://")


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, packed or plain; each file says its version first.

    A header line has the fields of the version, the last of which is the
    declared length of what follows; a line feed ends the record.
    """
    source, version = Reader(data), 0
    while not source.done():
        at = source.offset
        line = source.through(b"\n").decode("utf-8", "replace").split(" ")
        if not version:
            if not line[0].startswith("filedesc://") or len(line) != 5:
                raise ArchiveError("an ARC file starts with a filedesc line")
        elif len(line) != len(ARC_FIELDS[version].split()):
            raise ArchiveError(f"{len(line)} fields at byte {at} in version {version}")
        if not line[-1].isdigit():
            raise ArchiveError(f"no length at byte {at}")
        content = source.take(int(line[-1]))
        if not version:
            head = content.split(b"\n", 1)[0].split(b" ")[0]
            if head not in (b"1", b"2"):
                raise ArchiveError("unknown ARC version")
            version = int(head)
        yield ArcRecord(at, version, line[0], line[1], line[2], line[3], content)
        if not source.done() and source.take(1) != b"\n":
            raise ArchiveError(f"no line feed after the record at byte {at}")


def arc_head(version: int, url: str, ip: str, date: str, mime: str, length: int, code: int = 200) -> bytes:
    url = url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "-"
    more = "" if version == 1 else f" {code} - - 0 -"
    return f"{url} {ip} {date} {mime}{more} {length}\n".encode()


def filedesc(version: int, name: str) -> bytes:
    body = f"{version} 0 siftwick\n{ARC_FIELDS[version]}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {NO_DATE} text/plain {len(body)}\n".encode() + body


def arc_date(seconds: int | None) -> str:
    try:
        return NO_DATE if seconds is None else time.strftime("%Y%m%d%H%M%S", time.gmtime(seconds)).zfill(14)
    except (ValueError, OverflowError, OSError):
        return NO_DATE


def write_arc(pages: DataFrame, path: str, version: int = 1, seconds: Column | None = None, file: tuple[int, int] = FILE) -> None:
    """One HTTP response per page, captured at a time in seconds of the epoch; every file starts with its filedesc record."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for page, when, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                body = (html.as_py() or "").encode()
                key = "" if page is None else f"{PAGE_HEADER}: {page}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{key}\r\n".encode() + body
                yield arc_head(version, url.as_py() or "", "0.0.0.0", arc_date(when), "text/html", len(block)) + block + b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_rows(records(batches), lambda n: filedesc(version, f"part-{n}.arc") + b"\n", file)

    small_batches(pages.sparkSession)
    when = F.lit(None) if seconds is None else seconds
    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), when.cast("long").alias("seconds"), F.col("url"), F.col("html"))
    write_rows(cols.mapInArrow(run, "value binary"), path, file)


def http_parts(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers with lower-case names, head with its empty line, body) of an HTTP message."""
    end = content.find(b"\r\n\r\n")
    if not content.startswith(b"HTTP/") or end < 0:
        return {}, b"", content
    lines = content[:end].decode("utf-8", "replace").split("\r\n")[1:]
    heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return heads, content[: end + 4], content[end + 4 :]


def page_of(heads: dict[str, str]) -> int | None:
    value = heads.get(PAGE_HEADER.lower(), "")
    return int(value) if value.removeprefix("-").isdigit() else None


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], names=list(names))


def arc_digests(files: DataFrame) -> DataFrame:
    """(path, offset, page_id, payload_bytes, digest, url, date) of every record but filedesc ones."""
    schema = "path string, offset long, page_id long, payload_bytes long, digest binary, url string, date string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for r in parse_arc(content.as_py()):
                    if not r.describes:
                        heads, _, body = http_parts(r.content)
                        rows.append((path, r.offset, page_of(heads), len(body), hashlib.sha256(body).digest(), r.url, r.date))
                yield batch_of(rows, schema)

    return files.mapInArrow(run, schema)


# ARC to WARC


def revisits(digests: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(path, marks): in each file the records whose payload another one answers for, with that one's place, page_id, url and date.

    Of equal payloads the smallest page_id answers; null ids come last, and of
    repeated ids the first by file and offset.
    """
    order = F.struct(F.col("page_id").isNull().alias("no"), "page_id", "path", "offset", "url", "date")
    large = digests.where(F.col("payload_bytes") >= least)
    groups = large.groupBy("digest").agg(F.min(order).alias("top"), F.count("*").alias("n")).where("n > 1")
    again = large.hint("merge").join(groups.hint("merge"), "digest").where(order != F.col("top"))
    mark = F.struct("offset", *[F.col(f"top.{c}").alias(f"to_{c}") for c in ("page_id", "path", "offset", "url", "date")])
    return again.groupBy("path").agg(F.sort_array(F.collect_list(mark)).alias("marks"))


def record_id(path: str, offset: int, kind: str = "") -> str:
    """An id of the place in the archives, so that no two records share one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{path}:{offset}:{kind}')}>"


def warc_date(digits: str) -> str:
    """From 14 digits, or 12 without seconds; anything else is the start of the epoch."""
    try:
        return datetime.strptime(digits.ljust(14, "0") if len(digits) == 12 else digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20)
    except ValueError:
        return "1970-01-01T00:00:00Z"


def warc_record(heads: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*heads, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def converted(r: ArcRecord, path: str, mark: dict | None = None) -> bytes:
    """The WARC record that says the same as an ARC record; a mark makes it a revisit."""
    date = ("WARC-Date", warc_date(r.date))
    if r.describes:
        out = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(path, r.offset, "info")), date, ("Content-Type", "application/warc-fields")]
        return warc_record(out, b"software: siftwick\r\nformat: WARC File Format 1.1\r\n")
    _, head, body = http_parts(r.content)
    kind = "revisit" if mark else "response" if head else "resource"
    out = [("WARC-Type", kind), ("WARC-Record-ID", record_id(path, r.offset)), date, ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip)]
    out.append(("Content-Type", "application/http; msgtype=response" if head else r.mime))
    out.append(("WARC-Payload-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}"))
    if not mark:
        return warc_record(out, r.content)
    out += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(mark["to_path"], mark["to_offset"]))]
    out += [("WARC-Refers-To-Target-URI", mark["to_url"]), ("WARC-Refers-To-Date", warc_date(mark["to_date"]))]
    if mark["to_page_id"] is not None:
        out.append(("X-Refers-To-Page-Id", str(mark["to_page_id"])))
    return warc_record(out, head)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_REVISIT, file: tuple[int, int] = FILE) -> None:
    """Convert every ARC file below a path, of either version, packed or plain.

    A first pass over the archives finds equal payloads; the second writes.
    Between them digests are shuffled, and one row per file meets the marks of
    that file: up to MARKS_SENT marks go to the files, above that the files'
    contents, still compressed, are shuffled.
    """
    files = archives(spark, arc_path)
    digests = written(arc_digests(files), "arc-digests")
    marks = written(revisits(digests, least), "marks")
    n = marks.agg(F.sum(F.size("marks"))).first()[0] or 0

    def records(batches: Iterator[pa.RecordBatch], at: list) -> Iterator[bytes]:
        for b in batches:
            for path, content, marked in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                again = {m["offset"]: m for m in marked.as_py() or []}
                for r in parse_arc(content.as_py()):
                    if not r.describes:
                        at[:] = path, r.offset
                        yield converted(r, path, again.get(r.offset)) + b"\r\n\r\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list = []  # the record that a file begins with gives its head an id
        info = ArcRecord(0, 1, "filedesc://", "", NO_DATE, "", b"")

        def head(n: int) -> bytes:
            info.offset = at[1]
            return converted(info, at[0]) + b"\r\n\r\n"

        return in_rows(records(batches, at), head, file)

    joined = files.join(F.broadcast(marks) if n <= MARKS_SENT else marks, "path", "left").select("path", "content", "marks")
    write_rows(joined.mapInArrow(run, "value binary"), warc_path, file)
    remove(digests, marks)


# WARC


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a file, packed or plain."""
    source = Reader(data)
    while not source.done():
        at = source.offset
        lines = source.through(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ArchiveError(f"no WARC record at byte {at}")
        heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not heads.get("content-length", "").isdigit():
            raise ArchiveError(f"no length at byte {at}")
        block = source.take(int(heads["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ArchiveError(f"record at byte {at} does not end where it says")
        yield heads, block


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_date string, refers_to_uri string, refers_to_date string, record_id string, refers_to_record string, target_uri string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per response, resource or revisit; payload digests are made anew from full payloads and held against the headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                rows = []
                for heads, block in parse_warc(content.as_py()):
                    kind = heads["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, body = http_parts(block)
                    told = heads["warc-payload-digest"].removeprefix("sha256:")
                    if kind != "revisit" and hashlib.sha256(body).hexdigest() != told:
                        raise ArchiveError(f"payload digest of {heads['warc-record-id']} differs")
                    size = int(http.get("content-length", 0)) if kind == "revisit" else len(body)
                    ref = heads.get("x-refers-to-page-id")
                    more = [heads.get(f"warc-{x}") for x in ("date", "refers-to-target-uri", "refers-to-date", "record-id", "refers-to", "target-uri")]
                    rows.append((page_of(http), size, told, kind, None if ref is None else int(ref), *more))
                yield batch_of(rows, READ)

    return archives(spark, path).mapInArrow(run, READ)


def round_trip(pages: DataFrame, versions: tuple[int, ...] = (1, 2), seconds: Column | None = None) -> DataFrame:
    """Pages -> ARC files -> WARC files -> rows, one per page.

    Pages are dealt to the ARC versions by a hash. Null html is an empty
    payload, null urls are ``-``, null ids stay null, and null or impossible
    times are the start of the epoch. Repeated rows are records each, with ids
    of their own; of equal payloads with one page_id the first by place
    answers. Pages may be of any length that one value can have: a file ends
    by its bytes, and a task holds one file, packed, and one record. An empty
    table gives an empty one. Other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    for k, version in enumerate(versions):
        part = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(len(versions))) == k) if len(versions) > 1 else pages
        write_arc(part, f"{arc}/v{version}", version, seconds)
    arc_to_warc(spark, arc, warc)
    passing(spark, arc)
    passing(spark, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_date", "refers_to_uri", "refers_to_date")


#: For the query: pages have no time of their own, so their ids stand for one.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, replace(coalesce(url, '-'), ' ', '%20') AS url FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first, arg_min(url, page_id) OVER (PARTITION BY h) AS first_url FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first <> page_id AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to,
       strftime(make_timestamp(page_id * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date, CASE WHEN again THEN first_url END AS refers_to_uri,
       CASE WHEN again THEN strftime(make_timestamp(first * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS refers_to_date
FROM r
"""
