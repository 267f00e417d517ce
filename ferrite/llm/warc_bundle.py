"""WARC archives as seekable Zstandard bundles.

``write`` turns pages into WARC/1.1 records. Of rows with equal payloads the one with the largest id is a ``response``
that carries the payload; the others are ``revisit`` records that refer to it. Each task fills bundles: records are
grouped into independent Zstandard frames, and a footer seek table (the seekable format's skippable frame) ends the
file. The written index maps every record to its bundle, frame and offset within the frame. ``read`` opens the bundles
through their seek tables and parses every record; ``read_record`` fetches one record by seeking to one frame.

Bundles go to a folder that executors share, under names of their own for each attempt; only those that the index names
count, so a lost executor leaves no double records. Defined results: a null payload is an empty one; rows with a null id
never refer and are referred to only if no row of their payload has an id; rows that repeat the largest id are all
responses; a null URL gives no target header, and line breaks in one are percent-encoded. No rows give no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FRAME_BYTES = 1 << 18  # a frame closes when it holds this much
BUNDLE_BYTES = 1 << 26  # a bundle closes when it holds this much before compression
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id bigint, bundle string, frame int, offset bigint, length bigint"
INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
#: Tasks that read archives, at most; each reads whole bundles.
READERS = 20_000


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record; ``refers_to`` set makes it a revisit, without the payload."""
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of each record in a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        yield at, headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.coder = stream, zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.total = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Place of the record: (frame, offset in it)."""
        if self.held and self.held + len(data) > FRAME_BYTES:
            self.flush()
        at = (len(self.table), self.held)
        self.parts.append(data)
        self.held += len(data)
        self.total += len(data)
        return at

    def flush(self) -> None:
        if self.parts:
            packed = self.coder.compress(b"".join(self.parts))
            self.stream.write(packed)
            self.table.append((len(packed), self.held))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.stream.close()


def seek_table(stream) -> list[tuple[int, int, int]]:
    """(offset in the file, packed size, unpacked size) of each frame, read from the footer alone."""
    size = stream.size()
    stream.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("not a seekable bundle")
    stream.seek(size - 9 - 8 * n)
    rows, at = [], 0
    for packed, full in struct.iter_unpack("<II", stream.read(8 * n)):
        rows.append((at, packed, full))
        at += packed
    return rows


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if urlparse(uri).scheme == "file":
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def read_frame(bundle: str, frame: int) -> bytes:
    fs, path = _store(bundle)
    with fs.open_input_file(path) as f:
        at, packed, full = seek_table(f)[frame]
        f.seek(at)
        return zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=full)


def read_record(bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record through the index: one seek table and one frame are read."""
    data = read_frame(bundle, frame)
    _, headers, body = next(parse_records(data[offset:]))
    return headers, body


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives under ``folder``; the index (page_id, bundle, frame, offset, length), itself a written table."""
    spark = pages.sparkSession
    common.python_ready(spark)
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("html"))
    # 160 bits and the length stand for the payload. Only groups of two or more need the join; written first, so that
    # both of its sides are plain exchanges, whose hot keys AQE splits.
    narrow = pages.select(F.col(key).cast("bigint").alias("page_id"), F.sha1(body.cast("binary")).alias("digest"))
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    groups = common.materialise(groups, "warc-groups")
    joined = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).join(groups, "digest", "left")
    refers = F.when(F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("last"))), F.col("last"))
    todo = joined.select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _store(folder)
        fs.create_dir(top, recursive=True)
        writer, name, out = None, "", []

        def done() -> pa.RecordBatch:
            writer.close()
            got = pa.RecordBatch.from_pylist(out, INDEX_ARROW)
            out.clear()
            return got

        for b in batches:
            for page_id, u, text, ref in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{top}/{name}", compression=None))
                data = record(page_id, u, text.encode("utf-8", "surrogatepass"), ref)
                frame, offset = writer.add(data)
                out.append({"page_id": page_id, "bundle": f"{folder}/{name}", "frame": frame, "offset": offset, "length": len(data)})
                if writer.total >= BUNDLE_BYTES:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    return common.materialise(todo.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, parsed from the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        urn = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
        for b in batches:
            for bundle in b.column(0).to_pylist():
                fs, path = _store(bundle)
                with fs.open_input_file(path) as f:
                    for at, packed, full in seek_table(f):
                        f.seek(at)
                        rows = []
                        for _, h, body in parse_records(unpack.decompress(f.read(packed), max_output_size=full)):
                            if h["WARC-Type"] == "response" and digest(body) != h["WARC-Payload-Digest"][5:]:
                                raise ValueError(f"damaged record {h['WARC-Record-ID']}")
                            rows.append({"page_id": urn(h["WARC-Record-ID"]), "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"][5:], "record_type": h["WARC-Type"], "refers_to": urn(h.get("WARC-Refers-To"))})
                        yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)

    bundles = index.select("bundle").distinct()
    # A number of its own, as AQE would gather the short names in one task; dealt in turn, so that each task has its share.
    return bundles.repartition(max(1, min(READERS, bundles.count()))).mapInArrow(run, RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all pages written as WARC records, then read back from the archives."""
    return read(write(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "warc")))
