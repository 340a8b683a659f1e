"""WARC archives in Spark: writing, normalising and reading back.

Many writers gzip a whole archive as one stream, in which no record can be reached without inflating all before it. The
normaliser inflates such a stream once, chunk by chunk, rewrites every record as a gzip member of its own, and writes a sidecar
index of the members' offsets. Archives of a table are rows of bounded size in the shared folder, as Spark's executors share no
local disk; normalise() does the same between any two binary files."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.shared import by_arrow, read, stored

#: About as many bytes of records go to an archive; a larger record is an archive of its own.
ARCHIVE_BYTES = 4 << 20
LEVEL = 4
GZIP = 31
INDEX = "array<struct<offset: bigint, length: bigint, record_id: string, record_type: string, target_uri: string>>"


class DamagedArchive(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    raw: bytes


@dataclass
class Entry:
    """Where a record's member is in a normalised archive."""

    offset: int
    length: int
    record_id: str
    record_type: str
    target_uri: str


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(value: str) -> str:
    """Characters that would end a header line, percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A response with the payload in an HTTP message, or a revisit that holds the message's head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {header_value(uri or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def inflated(source: BinaryIO, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of one or more gzip members in a row, a bounded piece at a time."""
    machine = zlib.decompressobj(GZIP)
    begun = False
    while data := source.read(chunk):
        while data:
            begun = True
            if piece := machine.decompress(data, 1 << 20):
                yield piece
            data = machine.unconsumed_tail
            if machine.eof:
                data = machine.unused_data
                machine, begun = zlib.decompressobj(GZIP), False
    if begun:
        raise DamagedArchive("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """Records of an inflated archive; one record is in memory at a time."""
    have = bytearray()

    def fill(n: int) -> bool:
        while len(have) < n:
            if (piece := next(pieces, None)) is None:
                return False
            have.extend(piece)
        return True

    while fill(1):
        if have.startswith((b"\r", b"\n")):
            del have[: len(have) - len(have.lstrip(b"\r\n"))]
            continue
        seen = 0
        while (end := have.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(have)
            if not fill(seen + 1):
                raise DamagedArchive("a record has no end of headers")
        first, *lines = have[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not first.startswith("WARC/") or not headers.get("content-length", "").isdigit():
            raise DamagedArchive(f"no WARC record: {first[:40]!r}")
        size = end + 4 + int(headers["content-length"])
        if not fill(size):
            raise DamagedArchive("a record ends early")
        block = bytes(have[end + 4 : size])
        yield Record(headers, block, bytes(have[:size]) + b"\r\n\r\n")
        del have[:size]


def normalise(source: BinaryIO, target: BinaryIO) -> list[Entry]:
    """Rewrites a gzipped archive, however its members are cut, with a member for each record. Returns the sidecar index."""
    index, at = [], 0
    for r in records(inflated(source)):
        machine = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        member = machine.compress(r.raw) + machine.flush()
        target.write(member)
        h = r.headers
        index.append(Entry(at, len(member), h.get("warc-record-id", "").strip("<>"), h.get("warc-type", ""), h.get("warc-target-uri", "")))
        at += len(member)
    return index


def read_at(archive: bytes, entry: Entry) -> Record:
    """The record of an index entry, from its own member alone."""
    return next(records(inflated(io.BytesIO(archive[entry.offset : entry.offset + entry.length]))))


def write_monolithic(rows: DataFrame) -> DataFrame:
    """rows: page_id, url, payload (binary), record_type, last. Returns archives, each one gzip stream of many records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, out = TaskContext.get().partitionId(), 0, 0, []
        machine = zlib.compressobj(1, zlib.DEFLATED, GZIP)

        def close() -> pa.RecordBatch:
            nonlocal number, size, out, machine
            done = pa.RecordBatch.from_pydict({"archive": [f"{part:06d}-{number:06d}"], "data": [b"".join([*out, machine.flush()])]})
            number, size, out, machine = number + 1, 0, [], zlib.compressobj(1, zlib.DEFLATED, GZIP)
            return done

        for batch in batches:
            for page, url, payload, kind, last in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "record_type", "last")), strict=True):
                body = payload.as_py()
                raw = record(kind.as_py(), f"urn:page:{page.as_py()}", url.as_py(), body, payload_digest(body), f"urn:page:{last.as_py()}")
                out.append(machine.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if size:
            yield close()

    return rows.mapInArrow(run, "archive string, data binary")


def normalised(archives: DataFrame) -> DataFrame:
    """Archives with a member for each record, and their sidecar indexes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name, data in zip(batch.column("archive"), batch.column("data"), strict=True):
            target = io.BytesIO()
            index = normalise(io.BytesIO(data.as_py()), target)
            kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string())]))
            yield pa.RecordBatch.from_pydict({"archive": [name.as_py()], "data": [target.getvalue()], "entries": pa.array([[vars(x) for x in index]], kind)})

    return by_arrow(archives, run, f"archive string, data binary, entries {INDEX}")


def read_back(archives: DataFrame) -> DataFrame:
    """A row for each record, each read from its member by the index. Payloads are hashed again and must match their headers."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            found = []
            for e in row["entries"]:
                r = read_at(row["data"], Entry(**e))
                head, _, payload = r.block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", head)[1])
                digest, kind = r.headers["warc-payload-digest"].removeprefix("sha1:"), r.headers["warc-type"]
                if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                    raise DamagedArchive(f"{e['record_id']} has another payload than its headers say")
                found.append((page_of(e["record_id"]), size, digest, kind, page_of(r.headers["warc-refers-to"].strip("<>")) if kind == "revisit" else None, e["target_uri"], row["archive"], e["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "archive", "offset"])

    return by_arrow(archives, run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string, archive string, offset bigint")


def page_of(record_id: str) -> int | None:
    tail = record_id.rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def planned(pages: DataFrame, min_bytes: int) -> DataFrame:
    """What to write: each page's payload, and whether an equal payload of another page stands for it. The largest ids are
    aggregates, and the join deals both sides anew by the payload's hash, so that Spark can split a payload that many pages share."""
    rows = pages.select(F.col("page_id").cast("bigint"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("at", F.unhex(F.sha2("payload", 256)))
    groups = rows.groupBy("at").agg(F.max("page_id").alias("last")).select(F.struct("at").alias("at"), "last")
    revisit = (F.octet_length("payload") >= min_bytes) & F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return rows.withColumn("at", F.struct("at")).join(groups, "at").select("page_id", "url", "payload", "last", F.when(revisit, "revisit").otherwise("response").alias("record_type"))


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html), normalises the archives, and reads them back.

    Null and empty html are empty payloads. Among equal payloads of at least min_bytes bytes, the largest page_id is the
    response; repeated rows with that id are all responses. A null page_id is smaller than any other; where a payload occurs with null
    ids only, its rows are responses. An empty table gives no archives and no rows. Other columns are not read.
    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, archive and offset."""
    whole = write_monolithic(planned(pages, min_bytes))
    return read_back(stored(normalised(whole), "archives", codec="none"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((list_sum(list_transform(range(0, 5),
           lambda k: (strpos('0123456789abcdef', substr(hex, CAST((i // 4) * 5 + k + 1 AS INT), 1)) - 1) * CAST(pow(16, 4 - k) AS INT)))
           // CAST(pow(32, 3 - i % 4) AS INT)) % 32 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM h
"""
