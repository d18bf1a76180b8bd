"""Legacy archives: write ARC files, convert them to WARC with revisit records, and read WARC back.

The converter reads the version block of an ARC file, takes the record layout of that version (v1: URL, IP, date, type,
length; v2: URL, IP, date, type, result code, checksum, location, offset, file name, length) and then the declared number
of bytes. For each record it synthesises what WARC asks for: a record identifier (a name-based UUID of archive and place,
so a repeated attempt gives the same one), an ISO timestamp from the 14-digit date, a record type and SHA-1 digests.

Duplicates are found over the whole collection: of records with equal payloads, the one with the largest page id is the
response and the others revisit it. Only (archive, place, digest) is shuffled; payloads stay in the archives, and each
archive is converted with the list of its own revisits, which its bounded size bounds. Archives are files of the
shared folder under names that no other task attempt uses, and a manifest table lists those of committed tasks only.

Nulls: a null payload is empty; a null URL gets a ``urn:`` of its page; a null page id is kept and revisits any response.
Rows that repeat the largest page id of a payload are all responses. An empty table gives no archive and no row. Payload
bytes may hold anything, header lines included, for records are delimited by their declared lengths alone.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, new_path, read_bytes, write_bytes

#: The field lists that the two ARC versions declare in their version block.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 32 << 20
MEMBER_STEP = 8 << 10
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:credence:arc")
MANIFEST = "path string, n_records long"


class ArcRecord(NamedTuple):
    version: int
    uri: str
    ip: str
    date: str
    kind: str
    status: str
    http: bytes  # status line and header lines, with the blank line
    payload: bytes


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def packed(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """What each gzip member holds; plain data is one piece."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            parts.append(z.decompress(view[at : at + MEMBER_STEP]))
            at += MEMBER_STEP
        at = min(at, len(view)) - len(z.unused_data)
        yield b"".join(parts)


def arc_record(version: int, uri: str, date: str, status: str, block: bytes, ip: str = "0.0.0.0", kind: str = "text/html") -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
    middle = "" if version == 1 else f" {status} - - 0 -"
    return f"{uri} {ip} {date} {kind}{middle} {len(block)}\n".encode() + block + b"\n"


def arc_header(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 credence\n{ARC_FIELDS[version]}\n".encode()
    middle = "" if version == 1 else " 200 - - 0 -"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n".encode() + body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of a whole ARC file, plain or gzipped, without its version block."""
    version = 0
    for piece in members(data):
        at = 0
        while at < len(piece):
            if piece[at : at + 1] == b"\n":  # separators between records
                at += 1
                continue
            end = piece.index(b"\n", at)
            fields = piece[at:end].decode().split(" ")
            if not version:  # the version block is always first, and its first field line tells the layout of the rest
                length = int(fields[-1])
                block = piece[end + 1 : end + 1 + length].decode()
                version = int(block.split(" ", 1)[0])
                if not fields[0].startswith("filedesc://") or version not in ARC_FIELDS:
                    raise ValueError(f"not an ARC version block: {fields}")
                at = end + 1 + length
                continue
            if len(fields) != len(ARC_FIELDS[version].split(" ")):
                raise ValueError(f"an ARC {version} header line has {len(fields)} fields: {fields}")
            named = dict(zip(ARC_FIELDS[version].split(" "), fields, strict=True))
            length = int(named["Archive-length"])
            block = piece[end + 1 : end + 1 + length]
            if len(block) < length:
                raise ValueError(f"an ARC record declares {length} bytes and has {len(block)}")
            head, blank, _ = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
            yield ArcRecord(version, named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], named.get("Result-code", head[9:12].decode() or "-"), head + blank, block[len(head) + len(blank) :])
            at = end + 1 + length


def http_field(http: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?mi)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", http)
    return found[1].decode() if found else None


def iso_date(date: str) -> str:
    """14-digit ARC date -> W3C date; shorter ones are filled up with the smallest value."""
    return datetime.strptime(date + "00000101000000"[len(date) :], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(name: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{name}#{place}')}>"


def to_warc(r: ArcRecord, name: str, place: int, refers: tuple[str, int, str, str, int] | None) -> bytes:
    """A WARC record. refers: archive, place, URL, date and page of the response that it revisits."""
    block = r.http if refers else r.http + r.payload
    lines = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(name, place)), ("WARC-Date", iso_date(r.date)), ("WARC-Target-URI", r.uri), ("WARC-IP-Address", r.ip),
        ("WARC-Payload-Digest", f"sha1:{digest(r.payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Source-Format", f"arc/{r.version}"),
    ]
    if refers:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*refers[:2])), ("WARC-Refers-To-Target-URI", refers[2]), ("WARC-Refers-To-Date", iso_date(refers[3])), ("WARC-Refers-To-Page", str(refers[4]))]
    lines += [("Content-Type", "application/http; msgtype=response" if r.http else r.kind), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record."""
    for piece in members(data):
        f = io.BytesIO(piece)
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers = {}
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                k, _, v = line.decode().partition(":")
                headers[k.strip().lower()] = v.strip()
            block = f.read(int(headers["content-length"]))
            if len(block) < int(headers["content-length"]):
                raise ValueError("a WARC record is cut short")
            yield headers, block


def write_arc(pages: DataFrame, folder: str, *, date: str = "20240101000000") -> DataFrame:
    """Write pages(page_id, url, html) as ARC files of about ARCHIVE_BYTES, versions 1 and 2 in turn. Returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, parts, size, n = 0, [], 0, 0

        def close():
            path = f"{folder}/{uuid.uuid4().hex}.arc.gz"
            write_bytes(path, b"".join([packed(arc_header(version, path.rpartition("/")[2], date)), *parts]))
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html"))
            for page, url, html in zip(*columns, strict=True):
                payload = (html.as_py() or "").encode()
                version = version or 1 + (page.as_py() or 0) % 2
                known = f"X-Page-Id: {page.as_py()}\r\n" if page.is_valid else ""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n".encode()
                parts.append(packed(arc_record(version, url.as_py() or f"urn:page:{page.as_py()}", date, "200", http + payload)))
                size, n = size + len(payload) + len(http), n + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    version, parts, size, n = 3 - version, [], 0, 0
        if n:
            yield close()

    return pages.select("page_id", "url", "html").mapInArrow(run, MANIFEST)


def arc_digests(manifest: DataFrame) -> DataFrame:
    """(path, place, page, uri, date, digest, n_bytes) of each record of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = [(path, i, int(p) if (p := http_field(r.http, b"X-Page-Id")) is not None else None, r.uri, r.date, digest(r.payload), len(r.payload)) for i, r in enumerate(parse_arc(read_bytes(path)))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.int64()) for c, k in zip(zip(*rows, strict=True), (1, 0, 0, 1, 1, 1, 0), strict=True)], names=["path", "place", "page", "uri", "date", "digest", "n_bytes"])

    return spread(manifest).mapInArrow(run, "path string, place long, page long, uri string, date string, digest string, n_bytes long")


def spread(manifest: DataFrame) -> DataFrame:
    """One archive to a task, about."""
    return manifest.repartition(max(1, min(10_000, manifest.count())))


def revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(path, list of its revisits with what they refer to). Copies are aggregated before any shuffle of single rows."""
    able = records.where(F.col("n_bytes") >= min_bytes)
    first = able.groupBy("digest").agg(F.max(F.struct("page", "path", "place", "uri", "date")).alias("to"), F.count("*").alias("n")).where("n > 1 AND to.page IS NOT NULL").drop("n")
    later = able.select("path", "place", "page", "digest").join(first, "digest").where("page IS NULL OR page < to.page")
    return later.groupBy("path").agg(F.collect_list(F.struct("place", "to")).alias("again"))


def convert(manifest: DataFrame, folder: str, *, min_bytes: int = 0) -> DataFrame:
    """ARC archives -> WARC archives in folder; returns their manifest."""
    records = cut(arc_digests(manifest), "arc-records")
    work = manifest.join(revisits(records, min_bytes), "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                again = {x["place"]: x["to"] for x in row["again"] or ()}
                parts = []
                for i, r in enumerate(parse_arc(read_bytes(row["path"]))):
                    to = again.get(i)
                    parts.append(packed(to_warc(r, row["path"].rpartition("/")[2], i, to and (to["path"].rpartition("/")[2], to["place"], to["uri"], to["date"], to["page"]))))
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                write_bytes(path, b"".join(parts))
                yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([len(parts)], pa.int64())})

    return spread(work).mapInArrow(run, MANIFEST)


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, uri, warc_date, payload_bytes, payload_digest, record_type, refers_to) of each record of WARC archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for h, block in parse_warc(read_bytes(path)):
                    head, blank, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    page, revisit = http_field(head + blank, b"X-Page-Id"), h["warc-type"] == "revisit"
                    named = h["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and digest(payload) != named:
                        raise ValueError(f"{path}: a payload does not have its digest")
                    size = int(http_field(head, b"Content-Length") or 0) if revisit else len(payload)
                    refers = h.get("warc-refers-to-page")
                    rows.append((int(page) if page is not None else None, h["warc-target-uri"], h["warc-date"], size, named, h["warc-type"], int(refers) if refers else None))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "uri", "warc_date", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return spread(manifest).mapInArrow(run, "page_id long, uri string, warc_date string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """pages -> ARC -> WARC, read back."""
    folder = new_path(spark, "archives")
    arcs = cut(write_arc(pages, f"{folder}/arc"), "arc-manifest")
    return read_warc(cut(convert(arcs, f"{folder}/warc", min_bytes=min_bytes), "warc-manifest"))
