"""WARC archives in seekable Zstandard bundles.

A bundle holds WARC/1.1 records in independent Zstandard frames (several records each, about
FRAME_BYTES) and ends in the seekable format's seek table: a skippable frame with the compressed and
decompressed size of every frame. The index maps a record to (bundle, frame, offset in the frame), so
one record is read by decompressing one frame. A manifest names the bundles that count: those of lost
or repeated task attempts are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, need, scratch, stored

#: Payloads below this size are never revisits; record bytes in a frame; payload bytes in a bundle.
SMALL, FRAME_BYTES, BUNDLE_BYTES = 100, 1 << 18, 64 << 20
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _field(value: object) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, kind: str,
           refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit holds the HTTP header alone, which names the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _field(url)))
    if page_id is not None:
        head.append(("WARC-Page-ID", page_id))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"),
                 ("WARC-Refers-To-Page-ID", refers_to)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(WARC header, HTTP header, payload, end) of the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines)
    start, size = end + 4, int(head["Content-Length"])
    block = data[start:start + size]
    if data[start + size:start + size + 4] != b"\r\n\r\n":
        raise ValueError("record doesn't end as its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload, start + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """Random access to a bundle's frames through its seek table."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        count, _, magic = struct.unpack("<IBI", self.f.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = self.f.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for k in range(count):
            c, d = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, c, d))
            at += c

    def frame(self, k: int) -> bytes:
        import zstandard

        at, c, d = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.f.read_at(c, at), max_output_size=d)

    def record(self, frame: int, offset: int):
        return parse_record(self.frame(frame), offset)


def record_plan(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """Pages with payload_bytes, payload_digest, record_type and refers_to.

    Of pages with equal payloads of at least SMALL bytes, the one with the smallest id (nulls last) is the
    response. Groups are reduced to their smallest id before the shuffle; only pages that revisit another
    are joined to their html again, so the html moves once.
    """
    p = need(pages, id_col, url, html).toDF("page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})
    keys = stored(p.where(F.col("payload_bytes") >= SMALL).select("page_id", "payload_digest"), "digests")
    first = stored(keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
                   .select("payload_digest", "first"), "firsts")
    again = keys.join(first, "payload_digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    again = stored(again.select(F.col("payload_digest").alias("digest2"), F.col("page_id").alias("id2"), F.col("first").alias("refers_to"))
                   .distinct(), "revisits")
    same = (p["payload_digest"] == again["digest2"]) & p["page_id"].eqNullSafe(again["id2"])
    return p.join(again, same, "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def write_bundles(pages: DataFrame, out: str, id_col: str = "page_id", url: str = "url", html: str = "html",
                  date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record per page below ``out``; returns the index (path, frame, offset, page_id), one row per record."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, folder = filesystem(out)
        fs.create_dir(folder, recursive=True)
        z = zstandard.ZstdCompressor(level=3, write_content_size=True)
        f = name = None
        frames: list[tuple[int, int]] = []
        buffer, held, index, left = [], 0, [], bundle_bytes

        def flush() -> None:
            nonlocal buffer, held
            if buffer:
                raw = b"".join(buffer)
                packed = z.compress(raw)
                f.write(packed)
                frames.append((len(packed), len(raw)))
                buffer, held = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal f, index, frames
            flush()
            f.write(seek_table(frames))
            f.close()
            cols = list(zip(*index))
            yield pa.RecordBatch.from_arrays([pa.array([f"{out}/{name}"] * len(index), pa.string()), pa.array(cols[0], pa.int32()),
                                              pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "frame", "offset", "page_id"])
            f, index, frames = None, [], []

        for b in batches:
            for lo in range(0, b.num_rows, 128):
                for r in b.slice(lo, 128).to_pylist():
                    if f is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        f, left = fs.open_output_stream(f"{folder}/{name}", compression=None), bundle_bytes
                    raw = record(r["page_id"], r["url"], r["html"].encode(), r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"], date)
                    if buffer and held + len(raw) > frame_bytes:
                        flush()
                    index.append((len(frames), held, r["page_id"]))
                    buffer.append(raw)
                    held += len(raw)
                    left -= len(raw)
                    if left <= 0:
                        yield from close()
        if f is not None:
            yield from close()

    plan = record_plan(pages, id_col, url, html)
    plan = plan.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})
    return stored(plan.mapInArrow(write, "path string, frame int, offset bigint, page_id bigint"), "warc-index")


def read_bundles(index: DataFrame, full: bool = False) -> DataFrame:
    """Every record of the index's bundles: (page_id, payload_bytes, payload_digest, record_type, refers_to[, url, payload]).

    A task opens a bundle once, decompresses the frames that it needs and finds each record by its offset.
    Responses are checked: their payload has the length and digest that their header names.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = path = None
        frame, data = -1, b""
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["path"] != path:
                    path, bundle, frame = r["path"], Bundle(r["path"]), -1
                if r["frame"] != frame:
                    frame, data = r["frame"], bundle.frame(r["frame"])
                head, http, payload, _ = parse_record(data, r["offset"])
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(http["Content-Length"])
                if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"damaged record in {path}")
                ids = [int(head[k]) if k in head else None for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")]
                row = (ids[0], size, digest, head["WARC-Type"], ids[1])
                out.append((*row, head.get("WARC-Target-URI"), payload) if full else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: 7 if full else 5]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=names)

    # Records of a frame go to one task; frames, not whole bundles, are dealt out.
    dealt = index.repartition("path", "frame").sortWithinPartitions("path", "frame", "offset")
    return dealt.select("path", "frame", "offset").mapInArrow(
        read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", url string, payload binary" * full)


def warc_bundles(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages as bundles in the shared folder and returns every record read back."""
    return read_bundles(write_bundles(pages, scratch(pages.sparkSession, "warc"), id_col, url, html))
