"""Token-id files with fixed-width bit packing.

Layout of one file (little-endian):

    magic "NLUTOK1\\0" | bits u4 | block u4 | documents u8 | ids u8
    documents x (doc_id i8, is_null u8, first id u8, ids u8)
    blocks x (byte offset from the first block u8)
    blocks: each `block` ids, `bits` bits per id, least significant bit first, padded to a byte

Every id takes the minimum number of bits that the vocabulary needs, so id k lies in block
k // block at a computable bit; a block unpacks in one vectorised step and any document's ids are
read alone. One file holds a stretch of ascending doc_id; a manifest names the files that count, so
files of lost or repeated task attempts are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import prefix_sum
from .bpe import Bpe, _parts, bpe, encoded_words, hot_table, most_frequent, word_counts
from .common import discard, filesystem, need, release, scratch, stored, tidy

MAGIC, HEAD, DOC = b"NLUTOK1\0", struct.Struct("<8sIIQQ"), np.dtype([("doc", "<i8"), ("none", "<u8"), ("first", "<u8"), ("n", "<u8")])
#: Ids in a block; text bytes in a file; text bytes that are encoded together.
BLOCK, FILE_BYTES, ENCODE_BYTES = 1 << 16, 32 << 20, 1 << 24


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each; eight ids fill ``bits`` whole bytes."""
    n = len(ids)
    rows = np.zeros((-(-n // 8), 8), np.uint64)
    rows.reshape(-1)[:n] = ids
    out = np.zeros((len(rows), bits + 8), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = rows[:, k] << np.uint64(shift)
        for j in range(-(-(bits + shift) // 8)):
            out[:, byte + j] |= (value >> np.uint64(8 * j)).astype(np.uint8)
    return out[:, :bits].tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    groups = -(-n // 8)
    raw = np.zeros((groups, bits + 8), np.uint64)
    flat = np.zeros(groups * bits, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)[: groups * bits]
    raw[:, :bits] = flat.reshape(groups, bits)
    out = np.empty((groups, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = np.zeros(groups, np.uint64)
        for j in range(-(-(bits + shift) // 8)):
            value |= raw[:, byte + j] << np.uint64(8 * j)
        out[:, k] = ((value >> np.uint64(shift)) & mask).astype(np.uint32)
    return out.reshape(-1)[:n]


def file_bytes(doc: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    table = np.zeros(len(doc), DOC)
    table["doc"] = [0 if d is None else d for d in doc]
    table["none"] = [d is None for d in doc]
    table["n"] = lengths
    table["first"] = np.concatenate(([0], np.cumsum(lengths)[:-1])) if doc else []
    blocks = [pack(ids[k:k + block], bits) for k in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1])).astype("<u8") if blocks else np.zeros(0, "<u8")
    return b"".join([HEAD.pack(MAGIC, bits, block, len(doc), len(ids)), table.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Reads a token file: its documents, a block, or any stretch of ids."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.f = fs.open_input_file(path)
        magic, self.bits, self.block, docs, self.ids = HEAD.unpack(self.f.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.docs = np.frombuffer(self.f.read_at(docs * DOC.itemsize, HEAD.size), DOC)
        blocks, at = -(-self.ids // self.block), HEAD.size + docs * DOC.itemsize
        self.offsets = np.frombuffer(self.f.read_at(8 * blocks, at), "<u8")
        self.body = at + 8 * blocks

    def read(self, first: int, n: int) -> np.ndarray:
        """Ids first .. first + n - 1: only their blocks are read."""
        if not n:
            return np.zeros(0, np.uint32)
        lo, hi = first // self.block, (first + n - 1) // self.block
        start = int(self.offsets[lo])
        per = self.block * self.bits // 8
        count = min((hi + 1) * self.block, self.ids) - lo * self.block
        data = self.f.read_at(-(-count * self.bits // 8), self.body + start)
        parts = [unpack(data[k * per:(k + 1) * per], min(self.block, count - k * self.block), self.bits) for k in range(hi - lo + 1)]
        return np.concatenate(parts)[first - lo * self.block:][:n]


def encode_texts(t: Bpe, texts: pa.Array, end_id: int, known: pa.Array, known_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, each closed by ``end_id``; ids of each text). Each distinct word is looked
    up among the known ones or encoded once."""
    found, bounds = t.split(texts)
    found = found.dictionary_encode()
    ids = known_ids.take(pc.index_in(found.dictionary, value_set=known))
    if ids.null_count:
        left = pc.is_null(ids)
        ids = pc.replace_with_mask(ids, left, t.encoded(found.dictionary.filter(left).to_pylist()))
    flat, kind, ends = ids.take(found.indices), t.dtype, np.zeros(len(bounds), np.int64)
    body = np.zeros(0, kind)
    if len(flat):
        ends = np.frombuffer(flat.buffers()[1], np.int32)[bounds].astype(np.int64) // kind.itemsize
        body = np.frombuffer(flat.buffers()[2], kind, count=int(ends[-1]))
    out = np.full(len(body) + len(ends) - 1, end_id, kind)
    own = np.ones(len(out), bool)
    own[ends[1:] + np.arange(len(ends) - 1)] = False
    out[own] = body
    return out, np.diff(ends) + 1


def write_tokens(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text: str = "text",
                 end_id: int = 0, file_size: int = FILE_BYTES, block: int = BLOCK) -> DataFrame:
    """Writes token files of all rows below ``out``; returns their manifest (file_no, path, documents, ids).

    Rows are dealt to tasks by ranges of doc_id (nulls last) and the text's hash, as many as the text bytes ask for,
    and written in order; a task starts a new file after about ``file_size`` text bytes. Ties and repeated rows
    follow their text's hash, so one id's or all null ids' rows are dealt to many tasks. Null texts are
    empty; every document ends with ``end_id``; very long texts are a file of their own; an empty table has no
    documents; extra columns take no part.
    """
    rows = need(docs, id_col, text).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the most frequent words are encoded once for all tasks
    spark = docs.sparkSession
    counts = stored(word_counts(rows, path), "word-counts")
    hot = spark.sparkContext.broadcast(hot_table(encoded_words(most_frequent(counts), path)))
    discard(counts)
    release(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        t = bpe(path)
        bits = width(t.tok.get_vocab_size())
        fs, folder = filesystem(out)
        fs.create_dir(folder, recursive=True)
        task, done = TaskContext.get().partitionId(), []
        doc, n, body, left = [], [], [], file_size

        def close() -> None:
            ids = np.concatenate(body)
            name = f"{task:06d}-{len(done):04d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
                f.write(file_bytes(doc, n, ids, bits, block))
            done.append((task << 32 | len(done), f"{out}/{name}", len(doc), len(ids)))

        for b in batches:
            for part in _parts(b, min(ENCODE_BYTES, file_size)):
                ids, lengths = encode_texts(t, part.column("text"), end_id, *hot.value)
                doc += part.column("id").to_pylist()
                n += lengths.tolist()
                body.append(ids)
                left -= part.column("text").nbytes
                if left <= 0:
                    close()
                    doc, n, body, left = [], [], [], file_size
        if doc:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*done) if done else ([],) * 4, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["file_no", "path", "documents", "ids"])

    order = F.col("id").asc_nulls_last()
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(max(1, -(-size // file_size)), order, tie).sortWithinPartitions(order, tie)
    return stored(dealt.mapInArrow(tidy(write), "file_no bigint, path string, documents bigint, ids bigint"), "manifest")


def read_tokens(manifest: DataFrame, full: bool = False) -> DataFrame:
    """Every document from the files: (doc_id, start, n_tokens, ids_crc32[, ids]), start over all files.

    One task reads whole files, documents of each file block by block; a file's first position is the
    distributed prefix sum over the manifest, one row per file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                f = TokenFile(path)
                for lo in range(0, len(f.docs), 1024):
                    d = f.docs[lo:lo + 1024]
                    first = int(d["first"][0])
                    ids = f.read(first, int(d["first"][-1] + d["n"][-1]) - first).astype("<u4")
                    own = [ids[int(a) - first:int(a) - first + int(n)].tobytes() for a, n in zip(d["first"], d["n"])]
                    cols = [pa.array(d["doc"], mask=d["none"].astype(bool)), pa.array(d["first"].astype(np.int64) + base),
                            pa.array(d["n"].astype(np.int64)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if full:
                        cols, names = [*cols, pa.array(own, pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    summed = prefix_sum(manifest.select("file_no", "path", "ids"), ["file_no"], "ids", "upto")
    listed = stored(summed.select("file_no", "path", (F.col("upto") - F.col("ids")).alias("base")), "listed")
    n = max(1, listed.count())
    return listed.repartition(n, "file_no").select("path", "base").mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * full)


def token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all texts as token files in the shared folder and returns every document read back:
    (doc_id, start, n_tokens, ids_crc32), see :func:`write_tokens` for nulls, ties, repeats and odd tables."""
    out = scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, out, id_col, text))
