"""WARC archives with identical payloads written once and revisited."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, salted, small_batches

#: Compressed bytes of a file, beyond which no record is begun.
FILE_BYTES = 16 << 20
#: Bytes of repeated digests and what goes with them up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Date of the records written, the same at every run.
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(binary: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 40 hex digits are eight groups of 20 bits, four base32 digits each."""
    hexed = F.sha1(binary)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type, refers_to and refers_to_uri to ``pages`` (page_id, url, payload and any others).

    Headers alone are shuffled by digest, for the smallest page_id. Pages then meet the digests that stand more than once: by a broadcast
    if those take BROADCAST_BYTES at most, so payloads stay where they are, else by a shuffle in which a digest's pages are dealt to
    several tasks. Of the pages with equal payloads of ``min_bytes`` or more the one with the smallest page_id is ``response``, the others
    ``revisit`` it; smaller payloads are all ``response``. A null payload is empty. A row that repeats the smallest
    page_id with the same payload is a response too. Among equal payloads a null page_id counts as larger than any
    number; where all are null each is a response. Columns with the names of the new ones are replaced; an empty table gives an empty one.
    """
    pages = pages.drop("payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_uri")
    payload = F.coalesce("payload", F.lit("")).cast("binary")
    pages = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": base32_sha1(payload)})
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("url").alias("uri")))
    first = pages.select("payload_digest", "page_id", "url").groupBy("payload_digest").agg(least.alias("first"), F.count("*").alias("n"))
    name = free_name(pages, "first")
    first = cut(first.where("n > 1").select("payload_digest", F.struct("first.id", "first.uri").alias(name)))
    size = first.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(name)["uri"]), F.lit(0)) + 100), F.lit(0))).first()[0]
    met = pages.join(F.broadcast(first), "payload_digest", "left") if size <= BROADCAST_BYTES else salted(pages, first, ["payload_digest"], "page_id", "left")
    told = F.col(name)
    revisit = (F.col("payload_bytes") >= min_bytes) & told.isNotNull() & ~F.col("page_id").eqNullSafe(told["id"])
    return met.withColumns(
        {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, told["id"]), "refers_to_uri": F.when(revisit, told["uri"])}
    ).drop(name)


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """Names a record by page, payload and address; rows equal in all three are one record and share its name."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}:{zlib.crc32((url or '').encode()):08x}>"


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, refers_to_uri: str | None, payload: bytes) -> bytes:
    """A WARC/1.1 record without the line ends that close it. A revisit holds the HTTP header of the page only, whose Content-Length is
    that of the whole payload."""
    uri = lambda u: re.sub(r"[\x00-\x20]+", "%20", u)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_to_uri, digest)}", f"WARC-Refers-To-Date: {DATE}"]
        if refers_to_uri is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {uri(refers_to_uri)}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def _member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def packs(resolved: DataFrame) -> DataFrame:
    """(pack): records as gzip members, FILE_BYTES of them in a row and the one that passes it; the line ends that close the last are left to
    the writer."""
    names = ["record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to", "refers_to_uri", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join([*held, _member(last)])], pa.binary())], ["pack"])

        held: list[bytes] = []
        size, last = 0, None
        for b in small_batches(batches, 64):
            for *head, payload in zip(*(b.column(i).to_pylist() for i in range(len(names))), strict=True):
                if last is not None and size >= FILE_BYTES:
                    yield pack()
                    held, size = [], 0
                elif last is not None:
                    held.append(_member(last + END))
                    size += len(held[-1])
                last = record(*head, (payload or "").encode())
        if last is not None:
            yield pack()

    return resolved.select(*names).mapInArrow(run, "pack binary")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, payload) as deduplicated WARC files under ``path``, a gzip member for each record.

    Spark's own text writer puts the files, so any store that Spark reaches will do and a lost task leaves nothing behind: a line is a pack
    of members, a file holds one, and the line separator is a member of its own with the line ends that close the last record. Nulls and repeated
    rows: see ``resolve``. An empty table writes no records.
    """
    lines = packs(resolve(pages.select("page_id", "url", "payload"), min_bytes)).select(F.col("pack").cast("string"))
    lines.write.mode("overwrite").options(lineSep=_member(END).decode("latin-1"), encoding="ISO-8859-1", maxRecordsPerFile=1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``: page_id, record_type, refers_to, payload_bytes, payload_digest, payload, intact.

    Lengths come from Content-Length alone, so payloads may hold anything. For a response the length and digest are those of the
    bytes read, and ``intact`` tells if they agree with its header; a revisit states those of the page it refers to, its payload is null.
    Archives without records give no rows. A row sent to Python is a whole file, which FILE_BYTES bounds.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from _batches(_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean")


def _page(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?[0-9]+):[A-Z2-7]{32}:[0-9a-f]{8}>", value or b"")
    return int(m[1]) if m else None


def _head(f: BinaryIO) -> dict[bytes, bytes]:
    """Header lines up to the empty one, without the first; empty at the end of the file."""
    f.readline()
    out = {}
    while line := f.readline().rstrip(b"\r\n"):
        name, value = line.split(b": ", 1)
        out[name] = value
    return out


def _records(f: BinaryIO) -> Iterator[tuple]:
    """The records of one archive, one at a time."""
    while header := _head(f):
        block = io.BytesIO(f.read(int(header[b"Content-Length"])))
        f.read(len(END))
        length = int(_head(block)[b"Content-Length"])
        digest = header[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
        payload, intact, kind = None, True, header[b"WARC-Type"].decode()
        if kind == "response":
            payload = block.read()
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            intact = (found, len(payload)) == (digest, length)
            digest, length = found, len(payload)
        yield _page(header[b"WARC-Record-ID"]), kind, _page(header.get(b"WARC-Refers-To")), length, digest, payload, intact


def _batches(rows: Iterator[tuple], size: int = 100) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "intact"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    for some in itertools.batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(types)], names)
