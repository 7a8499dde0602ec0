"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes``.  After the last frame
comes the seekable format's footer: a skippable frame that lists each frame's compressed and
original size and checksum.  The index maps a record's identifier to (archive, frame, offset
within the frame, length), so that one record costs one seek and one small decompression.

Of pages with equal payloads of at least ``revisit_bytes`` the one of the largest page_id is a
response record, the others are revisit records that point to it (rows that repeat that page_id are
responses too).  Smaller payloads are always responses.  A null payload is empty.  Null urls leave
the target out.  Null page_ids are written without a number and read back as null.  Very long payloads have a frame of
their own.  Rows that share a page_id are records each for itself, equal rows too.  An empty table writes no archive.
Columns other than page_id, url and html are not read.

Each task writes its own archives under names given by its partition, sorted by page_id, first under
a temporary name: a repeated attempt replaces them by the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.plans.storage import shared_dir, table

# Fixed values of the seekable format and of the archive format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "page_id long, archive string, frame int, offset long, length long"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


@dataclass(frozen=True)
class WarcParams:
    revisit_bytes: int = 1000
    frame_bytes: int = 128 << 10
    archive_bytes: int = 64 << 20
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _from_urn(value: str) -> int | None:
    digits = value.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id, url, payload: bytes, kind: str, digest: str, refers_to, refers_url, size: int, p: WarcParams) -> bytes:
    """Bytes of one record; ``digest`` is the hexadecimal SHA-1 of the whole payload, ``size`` its length."""
    clean = lambda u: re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", u)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {p.date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Refers-To-Date: {p.date}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {clean(refers_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(["WARC/1.1", *head]).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames of one archive."""

    def __init__(self, p: WarcParams):
        self.p, self.out, self.table, self.open = p, bytearray(), [], bytearray()
        self.compress = zstandard.ZstdCompressor(level=p.level).compress

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset within it) of the record."""
        if self.open and len(self.open) + len(data) > self.p.frame_bytes:
            self.flush()
        at = len(self.table), len(self.open)
        self.open += data
        return at

    def flush(self) -> None:
        if self.open:
            raw = bytes(self.open)
            packed = self.compress(raw)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.out += packed
            self.open.clear()

    def finish(self) -> bytes:
        self.flush()
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        tail = entries + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE_MAGIC, len(tail)) + tail


class BundleReader:
    """Random access to the frames of an archive."""

    def __init__(self, uri: str):
        filesystem, path = fs.FileSystem.from_uri(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & CHECKSUM_FLAG else 8
        entries = self._at(size - 9 - n * width, n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, raw = struct.unpack_from("<II", entries, k * width)
            check = struct.unpack_from("<I", entries, k * width + 8)[0] if width == 12 else None
            self.frames.append((at, packed, raw, check))
            at += packed
        self.expand = zstandard.ZstdDecompressor().decompress

    def _at(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def frame(self, k: int) -> bytes:
        at, packed, raw, check = self.frames[k]
        data = self.expand(self._at(at, packed), max_output_size=raw)
        if len(data) != raw or check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def record(self, k: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        """Headers and body of the record that the index places there."""
        return next(records(self.frame(k)[offset : offset + length]))

    def close(self) -> None:
        self.file.close()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record in a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def http_parts(body: bytes) -> tuple[int, bytes]:
    """(payload length that the HTTP header states, payload)."""
    end = body.index(b"\r\n\r\n")
    return int(re.search(rb"\r\nContent-Length: (\d+)", body[:end])[1]), body[end + 4 :]


def planned(pages: DataFrame, p: WarcParams) -> DataFrame:
    """Pages with digest, size, record_type, refers_to and refers_url.

    Which pages are revisits is settled on ids and digests alone; payloads are dealt at most once."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    large = rows.filter(F.col("size") >= p.revisit_bytes).select("page_id", "url", "digest")
    same = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first"), F.max_by("url", "page_id").alias("first_url")).filter("n > 1 AND first IS NOT NULL")
    later = large.join(same, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    later = later.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first", "first_url").distinct()
    joined = rows.join(later, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("first").isNotNull()
    return joined.select("page_id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("first").alias("refers_to"), F.col("first_url").alias("refers_url"))


def write(pages: DataFrame, to: str, p: WarcParams = WarcParams()) -> DataFrame:
    """Write the archives below the URI ``to``; returns the index (a table written beside them)."""

    def run(batches):
        part = TaskContext.get().partitionId()
        filesystem, base = fs.FileSystem.from_uri(to)
        writer, index, k = BundleWriter(p), [], 0

        def close():
            name = f"part-{part:06d}-{k:04d}.warc.zst"
            temporary = posixpath.join(base, f".{name}.{uuid.uuid4().hex}")
            with filesystem.open_output_stream(temporary) as f:
                f.write(writer.finish())
            filesystem.move(temporary, posixpath.join(base, name))
            ids, frames, offsets, lengths = zip(*index, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["page_id", "archive", "frame", "offset", "length"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "record_type", "digest", "refers_to", "refers_url", "size")]
            for i in range(batch.num_rows):
                page, url, html, kind, digest, refers, refers_url, size = (c[i].as_py() for c in columns)
                data = record(page, url, html.encode("utf-8", "replace"), kind, digest, refers, refers_url, size, p)
                index.append((page, *writer.add(data), len(data)))
                if len(writer.out) > p.archive_bytes:
                    yield close()
                    writer, index, k = BundleWriter(p), [], k + 1
        if index:
            yield close()

    filesystem, base = fs.FileSystem.from_uri(to)
    filesystem.create_dir(base, recursive=True)
    rows = planned(pages, p)
    dealt = rows.sortWithinPartitions("page_id", "digest", "url")
    return table(dealt.mapInArrow(run, INDEX_SCHEMA), "warc-index")


def read(index: DataFrame, at: str) -> DataFrame:
    """Read every record back by its place in the index: one row per record with its facts.

    Records must be where the index says; responses are checked against their digest.  Frames are dealt out, so one
    archive is read by many tasks, and a frame is expanded once."""

    def run(batches):
        reader, name, number, data = None, None, None, b""
        for batch in batches:
            out = []
            for page, archive, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("page_id", "archive", "frame", "offset", "length")), strict=True):
                if archive != name:
                    if reader is not None:
                        reader.close()
                    reader, name, number = BundleReader(f"{at}/{archive}"), archive, None
                if frame != number:
                    data, number = reader.frame(frame), frame
                head, body = next(records(data[offset : offset + length]))
                digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                size, payload = http_parts(body)
                if _from_urn(head["WARC-Record-ID"]) != page:
                    raise ValueError(f"{name}: the index places {page} where {head['WARC-Record-ID']} is")
                if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{name}: {head['WARC-Record-ID']} is damaged")
                refers = head.get("WARC-Refers-To")
                out.append((page, size, digest, head["WARC-Type"], refers and _from_urn(refers)))
            columns = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if reader is not None:
            reader.close()

    dealt = index.repartition("archive", "frame").sortWithinPartitions("archive", "frame", "offset")
    return dealt.mapInArrow(run, READ_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in to:
        to = ("file://" if to.startswith("/") else "") + re.sub(r"^file:/+", "file:///", to)
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), to), to)


def oracle(p: WarcParams = WarcParams()) -> str:
    return f"""
WITH r AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= {p.revisit_bytes} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""
