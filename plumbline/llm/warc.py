"""WARC archives of pages, and a reader that salvages what it can.

Archives are written by Spark's text writer: a record ends with two line ends, and the last line feed is the writer's
own separator, so the files are plain WARC. The reader checks each record's header, length, end and digests. After a
failed check it looks for the next version line or gzip member, whatever the archive began with, goes on there, and
logs the bytes in between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, map_arrow
from plumbline.session import scratch_path

#: Payloads of fewer bytes are never stored as a reference to another record.
LEAST_REVISIT = 1000
#: Most records of a file, and bytes that it should not exceed unless it is a single record.
FILE_RECORDS, FILE_BYTES = 2000, 1 << 28
#: Bytes of a record's headers without its url.
HEAD_BYTES = 2000

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

_START = re.compile(rb"WARC/1\.[01]\r\n")
_CONTROL = re.compile(rb"[\x00-\x08\x0b-\x1f\x7f]")
_MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")


def revisits(pages: DataFrame) -> DataFrame:
    """``digest``, ``first`` of payloads that several pages share: the largest ``page_id`` holds the payload."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    sized = pages.select(F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"), F.col("page_id").cast("long").alias("id"))
    shared = sized.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(
        F.max("id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    return cut(shared.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "revisits")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """``value``, one WARC record per page, without its last line feed.

    The payload is the html in UTF-8 (null: empty). Pages whose payloads are equal and have at least ``LEAST_REVISIT``
    bytes share the record of the largest ``page_id``; the others refer to it. Pages without ``page_id`` hold their
    payload only if no other page does. Line ends and other controls in a url are percent-coded; a null url is left out.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("bytes"),
    )
    joined = base.join(revisits(pages), "digest", "left")
    refers = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.when(refers, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.regexp_replace("url", "%", "%25"), r"[\x00-\x20\x7F]", "%20")
    nothing = F.lit("")
    head = F.concat(
        F.lit(VERSION.decode() + "\r\n"),
        _line("WARC-Type", F.when(refers, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _uri(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", url), nothing),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.encode("block", "UTF-8")))),
        F.when(refers, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _uri(F.col("first"))))).otherwise(nothing),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    return joined.withColumn("block", block).select(F.concat(head, F.col("block"), F.lit("\r\n\r")).alias("value"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Plain WARC files of at most ``FILE_RECORDS`` records and about ``FILE_BYTES`` bytes each in a new folder.

    Records that are too large for ``FILE_RECORDS`` of them are written apart, fewer to a file.
    """
    bytes_of = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in ("html", "url")]
    largest = (pages.agg(F.max(bytes_of[0] + 3 * bytes_of[1])).first()[0] or 0) + HEAD_BYTES
    rows, usual = records(pages), FILE_BYTES // FILE_RECORDS

    def write(part, count):
        out = part.write.mode("append").option("maxRecordsPerFile", count).option("lineSep", "\n")
        out.option("compression", "none").text(folder)

    if largest <= usual:
        write(rows, FILE_RECORDS)
        return
    size = F.octet_length("value")
    write(rows.where(size <= usual), FILE_RECORDS)
    write(rows.where(size > usual), max(FILE_BYTES // largest, 1))


def _headers(raw: bytes) -> dict[str, str]:
    found = {}
    for line in raw.split(b"\r\n")[1:]:
        name, mark, value = line.partition(b":")
        if not mark or _CONTROL.search(line):
            raise ValueError("header line")
        found[name.strip().lower().decode("utf-8", "strict")] = value.strip().decode("utf-8", "strict")
    return found


def _record(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """Headers of the record at ``at``, and where its block starts and ends; ValueError says which check failed."""
    if not _START.match(data, at):
        raise ValueError("version line")
    stop = data.find(END, at)
    if stop < 0:
        raise ValueError("header end")
    headers = _headers(data[at:stop])
    if not headers.get("content-length", "").isdigit():
        raise ValueError("content length")
    start = stop + len(END)
    end = start + int(headers["content-length"])
    if data[end : end + len(END)] != END:
        raise ValueError("record end")
    wanted = headers.get("warc-block-digest")
    if wanted and wanted != "sha1:" + hashlib.sha1(data[start:end]).hexdigest():
        raise ValueError("block digest")
    if headers.get("warc-type") == "response" and (wanted := headers.get("warc-payload-digest")):
        body = data.find(END, start, end)
        if body < 0 or wanted != "sha1:" + hashlib.sha1(data[body + len(END) : end]).hexdigest():
            raise ValueError("payload digest")
    return headers, start, end


Found = tuple[int, int, dict[str, str] | None, bytes, str | None]


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of one archive, as offset, length, headers, block and reason; plain records and gzip members may mix.

    A gap has no headers and names the first check that failed. What a member holds has the member's offset, and its
    length once: all but the first have length 0. Of a broken member, records before another one's version line are
    kept with length 0, and its bytes are a gap.
    """
    at, bad, reason = 0, None, None
    version = _START.search(data)
    while at < len(data):
        broken = None
        try:
            if _START.match(data, at):
                headers, start, end = _record(data, at)
                found, there = [(at, end + len(END) - at, headers, data[start:end], None)], end + len(END)
            elif _MEMBER.match(data, at):
                plain, there = _unpacked(data, at)
                inside = list(_plain(plain))
                if there is None:
                    found, broken = [f for f in inside if f[2] and _START.match(plain, f[0] + f[1])], "gzip member"
                elif not any(f[2] for f in inside):
                    raise ValueError(inside[0][4] if inside else "empty member")
                else:
                    found = inside
                size = there - at if there is not None else 0
                found = [(at, 0 if i else size, *f[2:]) for i, f in enumerate(found)]
            else:
                raise ValueError("version line")
        except ValueError as error:
            found, broken = [], str(error)
        if bad is not None and found:
            yield bad, at - bad, None, b"", reason
            bad = None
        yield from found
        if broken is None:
            at = there
            continue
        if bad is None:
            bad, reason = at, broken
        if version and version.start() <= at:
            version = _START.search(data, at + 1)
        at = _next_member(data, at + 1, version.start() if version else len(data))
    if bad is not None:
        yield bad, len(data) - bad, None, b"", reason


def _unpacked(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` holds and where it is over; if it is broken, what comes before that and None."""
    member, plain, view = zlib.decompressobj(31), [], memoryview(data)
    while at < len(data) and not member.eof:
        part, before = view[at : at + (1 << 16)], member.copy()
        try:
            plain.append(member.decompress(part))
        except zlib.error:
            try:
                for i in range(len(part)):
                    plain.append(before.decompress(part[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(plain), None
        at += len(part)
    return b"".join(plain), at - len(member.unused_data) if member.eof else None


def _next_member(data: bytes, at: int, stop: int) -> int:
    """Where the next gzip member before ``stop`` begins that unpacks to a version line; ``stop`` if there is none."""
    for found in _MEMBER.finditer(data, at, stop):
        try:
            if _START.match(zlib.decompressobj(31).decompress(data[found.start() : found.start() + 4096], 64)):
                return found.start()
        except zlib.error:
            continue
    return stop


def _plain(data: bytes) -> Iterator[Found]:
    at, bad, reason = 0, None, None
    while at < len(data):
        try:
            headers, start, end = _record(data, at)
        except ValueError as error:
            if bad is None:
                bad, reason = at, str(error)
            found = _START.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            yield bad, at - bad, None, b"", reason
            bad = None
        yield at, end + len(END) - at, headers, data[start:end], None
        at = end + len(END)
    if bad is not None:
        yield bad, len(data) - bad, None, b"", reason


ROWS = (
    "archive string, at long, length long, gap string, page_id long, url string, record_type string, refers_to long,"
    " payload_digest string, payload_bytes long, payload binary"
)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``folder``; ``gap`` is the reason of a gap and null for a record.

    ``payload_bytes`` is the length of the full payload, for revisits as their HTTP header tells it. ``payload`` is null
    for revisits and without ``payloads``. A file is one task's work; write them of bounded size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.strip().rsplit(" ", 1) for f in ROWS.split(",")]
    length = re.compile(rb"\r\ncontent-length: *(\d+)", re.IGNORECASE)
    ident = re.compile(r"<urn:page:(-?\d+)>")

    def number(text):
        found = ident.fullmatch(text or "")
        return int(found[1]) if found else None

    def row(path, at, size, headers, block, reason):
        if headers is None:
            return (path, at, size, reason, *[None] * 7)
        http, _, body = block.partition(END)
        told = length.search(http)
        response = headers.get("warc-type") == "response"
        return (
            path, at, size, None, number(headers.get("warc-record-id")), headers.get("warc-target-uri"), headers.get("warc-type"),
            number(headers.get("warc-refers-to")), (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            len(body) if response else int(told[1]) if told else None, body if response and payloads else None,
        )

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held, size = [], 0
                for found in salvage(content.as_buffer().to_pybytes()):
                    held.append(row(path, *found))
                    size += len(found[3])
                    if len(held) >= 1000 or size > 8_000_000:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])

    return map_arrow(files, parse, ROWS)


def archived(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write the pages' archives to a new folder in the shared place and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder, payloads)
