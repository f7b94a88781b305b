"""Passage containment: which documents contain which passages, and where (first occurrence).

Spark has no multi-pattern substring join. Each passage gives one anchor: a stretch of ANCHOR characters at a
place drawn by its hash (the whole passage where it is shorter). Documents are scanned once: every place whose
stretch is, by its hash, some passage's anchor leaves a row with its surroundings, as far as the longest passage
reaches. Those rows meet the passages in an equi-join on the anchor's hash, and the passage is compared in place.

What the scan knows of the anchors is a bit table of fixed size (a hash that is not in it is no anchor), filled by an
aggregation; a set bit of another hash only costs a row that the join drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grams import code_points, gram_hashes
from ..session import cut_lineage

ANCHOR = 16
# bits a passage, bounds of the table's bits as powers of two (at most 16 MB), text characters scanned together
BITS_PER_PASSAGE, LEAST_BITS, MOST_BITS, SCAN = 64, 16, 27, 1 << 20


def anchors(passages: DataFrame, item_id: str, passage: str) -> DataFrame:
    """(item_id, passage, n, at, length, hash): the place and hash of each non-empty passage's anchor."""
    p = passages.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage")).filter(F.length("passage") > 0)
    p = p.withColumn("n", F.length("passage"))
    p = p.withColumn("length", F.least(F.col("n"), F.lit(ANCHOR)))
    p = p.withColumn("at", F.pmod(F.xxhash64("passage"), (F.col("n") - F.col("length") + 1).cast("long")).cast("int"))
    p = p.withColumn("_a", F.expr("substring(passage, at + 1, length)"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_a").to_pylist()
            codes, first = code_points(texts)
            sizes = np.diff(first) - 1
            by_length = gram_hashes(codes, np.unique(sizes).tolist())
            h = np.array([by_length[n][k] for n, k in zip(sizes.tolist(), first[:-1].tolist())], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("item_id", "passage", "n", "at", "length")), pa.array(h)],
                                             names=["item_id", "passage", "n", "at", "length", "hash"])

    kind = p.schema["item_id"].dataType.simpleString()
    return p.select("item_id", "passage", "n", "at", "length", "_a").mapInArrow(
        hashed, f"item_id {kind}, passage string, n int, at int, length int, hash bigint")


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """The low ``bits`` bits of every hash as set bits of a table of 2^bits."""
    low = F.col("hash").bitwiseAND((1 << bits) - 1)
    words = (hashes.select(F.shiftright(low, 6).alias("w"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("b"))
                   .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(max(1, (1 << bits) >> 6), dtype=np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def find_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", passage: str = "text") -> DataFrame:
    """``(doc_id, item_id, start)`` for every document containing a (non-empty) passage; ``start``
    is the 0-based character offset of the first occurrence, as Python ``str.find``. Null texts contain
    nothing; rows that share an id are one document."""
    p = cut_lineage(anchors(passages, item_id, passage))
    stats = p.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("longest"), F.collect_set("length").alias("lengths")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, (int(stats["n"]) * BITS_PER_PASSAGE).bit_length()))
    table = docs.sparkSession.sparkContext.broadcast(bit_table(p.select("hash"), bits))
    lengths, reach, low = list(stats["lengths"]), int(stats["longest"] or 0), (1 << bits) - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for b in batches:
            texts, at = b.column("text").to_pylist(), 0
            while at < len(texts):
                last, size = at, 0
                while last < len(texts) and (last == at or size + len(texts[last]) <= SCAN):
                    size += len(texts[last])
                    last += 1
                some = texts[at:last]
                codes, first = code_points(some)
                where, hashes = [], []
                for h in gram_hashes(codes, lengths).values():
                    key = h & low
                    k = np.flatnonzero((known[key >> 6] >> (key & 63).astype(np.uint64)) & np.uint64(1))
                    where.append(k)
                    hashes.append(h[k])
                place = np.concatenate(where) if where else np.zeros(0, np.int64)
                owner = np.searchsorted(first, place, side="right") - 1
                pos = place - first[owner]
                begin = np.maximum(pos - reach, 0)
                around = [some[o][a:p + reach] for o, a, p in zip(owner.tolist(), begin.tolist(), pos.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(owner + at)), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)),
                     pa.array(pos), pa.array(begin), pa.array(around, pa.string())], names=["doc_id", "hash", "pos", "begin", "around"])
                at = last

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    kind = d.schema["doc_id"].dataType.simpleString()
    found = d.mapInArrow(scan, f"doc_id {kind}, hash bigint, pos bigint, begin bigint, around string")
    j = found.join(p, "hash").withColumn("start", F.col("pos") - F.col("at")).filter("start >= begin")
    j = j.filter(F.expr("substring(around, cast(start - begin + 1 as int), n) = passage"))
    return j.groupBy("doc_id", "item_id").agg(F.min("start").cast("int").alias("start"))
