"""SimHash near-dedup with vantage-point partitions.

Fingerprints are compared as distinct 64-bit values. A full 64-bit vantage point separates badly at
radius 4 (distances of unrelated fingerprints lie within 32 +- 4, so three quarters of all points
overlap each boundary); therefore the first partition is by distance zero to a vantage code in one
of ``bits + 1`` segments: two fingerprints within ``bits`` agree in one segment, so every pair meets
in one of those shards. A shard above ``block`` rows is divided into shells of equal Hamming
distance to a vantage point of its own; by the triangle bound only shells at most ``bits`` apart
can hold linked pairs, and a sub-shard is sent to exactly the sub-shards it overlaps. In a task, a
vantage-point tree finds the pairs: inner and outer ball recurse, and only points within ``bits`` of
the boundary are compared across it. Each shard returns a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, need, stored

#: Rows a shard may hold before it is divided; rows of a tree's leaf.
BLOCK, LEAF = 8192, 512


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of a whole text; 0 without words."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1:].tolist())), "<u8", len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row; one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    rows = need(docs, id_col, text).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) within ``bits``, compared in bounded blocks."""
    left, right = [], []
    step = max(1, (1 << 21) // max(1, len(b)))
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[k:k + step, None] ^ b[None, :]) <= bits)
        left.append(i + k)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


class Forest:
    """Union-find over the rows of one shard."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def tree_links(fps: np.ndarray, bits: int, forest: Forest, leaf: int = LEAF) -> None:
    """Vantage-point tree self-join: joins in ``forest`` every pair of rows within ``bits``."""
    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            i, j = _close(fps[at], fps[at], bits)
            keep = i < j
            forest.link(at[i[keep]], at[j[keep]])
            continue
        d = np.bitwise_count(fps[at] ^ fps[at[0]]).astype(np.int64)
        t = int(np.median(d))
        inner, outer = d <= t, d > t
        if not outer.any():  # at the largest distance: cut below it instead
            inner, outer, t = d < t, d >= t, t - 1
        if not inner.any() or not outer.any():
            for k in range(0, len(at), leaf):
                i, j = _close(fps[at[k:k + leaf]], fps[at[k:]], bits)
                forest.link(at[i + k], at[j + k])
            continue
        todo += [at[inner], at[outer]]
        near, far = at[inner & (d > t - bits)], at[outer & (d <= t + bits)]
        if len(near) and len(far):
            i, j = _close(fps[near], fps[far], bits)
            forest.link(near[i], far[j])


def _links(bits: int, leaf: int):
    """Arrow step: a shard's distinct fingerprints and sides -> spanning edges (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column("home"), batch.column("away")):
                x = np.asarray(left.values.to_numpy(zero_copy_only=False), np.int64)
                y = np.asarray(right.values.to_numpy(zero_copy_only=False), np.int64)
                fps = np.concatenate([x, y]).view(np.uint64)
                forest = Forest(len(fps))
                if len(y):
                    for k in range(0, len(x), leaf):
                        i, j = _close(fps[k:min(k + leaf, len(x))], fps[len(x):], bits)
                        forest.link(i + k, j + len(x))
                else:
                    tree_links(fps, bits, forest, leaf)
                root = np.fromiter((forest.root(i) for i in range(len(fps))), np.int64, len(fps))
                joined = np.nonzero(root != np.arange(len(fps)))[0]
                signed = fps.view(np.int64)
                a.append(signed[joined])
                b.append(signed[root[joined]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
    return run


def segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the ``bits + 1`` segments of 64 bits."""
    cuts = [round(64 * k / (bits + 1)) for k in range(bits + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def link_edges(distinct: DataFrame, bits: int = 4, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Spanning edges (a, b) of the graph of distinct fingerprints ``fp`` at ``bits`` or fewer bits."""
    code = [F.struct(F.lit(k).alias("seg"), F.expr(f"shiftrightunsigned(fp, {lo})").bitwiseAND(F.lit((1 << w) - 1)).alias("code"))
            for k, (lo, w) in enumerate(segments(bits))]
    cells = distinct.select("fp", F.explode(F.array(*code)).alias("c")).select("c.seg", "c.code", "fp")
    big = stored(cells.groupBy("seg", "code").agg(F.count("*").alias("n"), F.min("fp").alias("vantage"))
                 .where(F.col("n") > block), "big")
    divide = not big.isEmpty()
    small = cells.join(big, ["seg", "code"], "left_anti") if divide else cells
    whole = small.groupBy("seg", "code").agg(F.collect_list("fp").alias("home")).where(F.size("home") > 1).select(
        "home", F.array().cast("array<bigint>").alias("away"))
    if not divide:
        return whole.mapInArrow(_links(bits, leaf), "a bigint, b bigint")
    # A large shard: shells by distance to its vantage point, each cut into sub-shards of about `block` rows.
    shelled = stored(cells.join(big, ["seg", "code"]).select(
        "seg", "code", "fp", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))).alias("shell")), "shells")
    sizes = shelled.groupBy("seg", "code", "shell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("cuts"))
    sizes = stored(sizes, "cuts")
    placed = shelled.join(sizes, ["seg", "code", "shell"]).withColumn("cut", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("cuts")).cast("int"))
    subs = sizes.select("seg", "code", "shell", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    other = subs.select("seg", "code", F.col("shell").alias("shell2"), F.col("cut").alias("cut2"))
    pairs = subs.join(other, ["seg", "code"]).where(
        (F.abs(F.col("shell") - F.col("shell2")) <= bits)
        & (F.struct("shell", "cut") <= F.struct(F.col("shell2").alias("shell"), F.col("cut2").alias("cut"))))
    pairs = stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    same = (F.col("shell") == F.col("shell2")) & (F.col("cut") == F.col("cut2"))
    sides = pairs.select("seg", "code", "shell", "cut", "pair", F.lit(0).alias("side")).unionByName(
        pairs.where(~same).select("seg", "code", F.col("shell2").alias("shell"), F.col("cut2").alias("cut"), "pair", F.lit(1).alias("side")))
    split = placed.join(sides, ["seg", "code", "shell", "cut"]).groupBy("pair").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("fp"))).alias("home"),
        F.collect_list(F.when(F.col("side") == 1, F.col("fp"))).alias("away")).select("home", "away")
    return whole.unionByName(split).mapInArrow(_links(bits, leaf), "a bigint, b bigint")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4,
                  block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Near-duplicate groups: (doc_id, fingerprint, component_id), one row per input row.

    Null and empty texts have fingerprint zero and link like any other. component_id is the smallest
    id reachable over links of ``bits`` or fewer differing bits; null ids never become one while
    another id is there. Repeated rows share everything. Rows per fingerprint are reduced to their
    smallest id before fingerprints are compared, so exact copies cost nothing more.
    """
    fp = stored(fingerprints(docs, id_col, text, words), "fingerprints")
    distinct = stored(fp.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    comp = components(link_edges(distinct.select("fp"), bits, block, leaf))
    named = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    named = stored(named, "named")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    out = stored(named.join(lowest, "component").select("fp", "component_id"), "component-ids")
    return fp.join(out, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
