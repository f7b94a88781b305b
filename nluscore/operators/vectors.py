"""Exact top-k vector search (V2-V5), token pooling (V6) and the in-batch contrastive score.

Top-k plan: both sides are cut into blocks of bounded bytes by a hash of their rows. Every query block meets every
corpus block in a cell of its own: queries are repeated once per corpus block, corpus vectors once per
query block, and the two sides are cogrouped on the cell number. A cell is one matrix product (in tiles) and
leaves at most k hits per query; a window group limit cuts those to k per query before and after the
shuffle on the query. Nothing goes through the driver but two counts, nothing is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import EPS_NORM

# bytes of one side of a cell (as doubles), rows below which the corpus isn't cut for parallelism's sake, tile of a product
DEFAULT_CHUNK_BYTES = 8 << 20
BLOCK_ROWS = 4096
TILE = (512, 2048)


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    """Arrow list<float> column → (n, dim) float64 matrix; null vectors become NaN rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if n == 0:
        return np.zeros((0, 0))
    lens = col.value_lengths().to_numpy(zero_copy_only=False)
    valid = ~np.isnan(lens.astype("float64")) if lens.dtype.kind == "f" else np.ones(n, bool)
    dims = set(int(x) for x in lens[valid]) if valid.any() else {0}
    if len(dims) != 1:
        raise ValueError(f"vectors of different lengths: {sorted(dims)[:5]}")
    dim = dims.pop()
    if col.null_count == 0:
        return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)
    out = np.full((n, dim), np.nan)
    rows = col.to_pylist()
    for i, r in enumerate(rows):
        if r is not None:
            out[i] = r
    return out


def _normalize(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.maximum(n, EPS_NORM)


def _block_top(s: np.ndarray, ids: np.ndarray, k: int, pay: np.ndarray | None = None):
    """Exact k best per row of a score block (score desc, docid desc) without sorting the block:
    ``np.partition`` finds each row's k-th value, every score at or above it (ties included) is kept,
    and only those candidates are sorted. ``pay``: optional per-column payload carried along."""
    nq, n = s.shape
    if n <= k:
        return s, np.broadcast_to(ids, s.shape), (None if pay is None else np.broadcast_to(pay, s.shape))
    kth = np.partition(s, n - k, axis=1)[:, n - k]
    rows, cols = np.nonzero(s >= kth[:, None])
    sc, di = s[rows, cols], ids[cols]
    order = np.lexsort((-di, -sc, rows))
    rows, sc, di, cols = rows[order], sc[order], di[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(nq))[rows]
    keep = rank < k
    out_s = np.full((nq, k), -np.inf)
    out_i = np.zeros((nq, k), dtype=np.int64)
    out_s[rows[keep], rank[keep]] = sc[keep]
    out_i[rows[keep], rank[keep]] = di[keep]
    out_p = None
    if pay is not None:
        out_p = np.zeros((nq, k), dtype=np.int64)
        out_p[rows[keep], rank[keep]] = pay[cols[keep]]
    return out_s, out_i, out_p


def _merge(best_s, best_i, s, ids, k, best_p=None, pay=None):
    """Keep the k best per row of two candidate sets, order score desc then docid desc (a heap of
    (score, docid)); ``ids`` (and the optional payload) per column (1-D) or per cell (2-D)."""
    cs = np.concatenate([best_s, s], axis=1)
    ci = np.concatenate([best_i, np.broadcast_to(ids, s.shape)], axis=1)
    cp = None if pay is None else np.concatenate([best_p, np.broadcast_to(pay, s.shape)], axis=1)
    if cs.shape[1] <= k:
        return cs, ci, cp
    order = np.lexsort((-ci, -cs), axis=1)[:, :k]
    return (np.take_along_axis(cs, order, 1), np.take_along_axis(ci, order, 1),
            None if cp is None else np.take_along_axis(cp, order, 1))


def _codes(ids: pa.Array) -> np.ndarray:
    """Place of each id in ascending order."""
    out = np.empty(len(ids), dtype=np.int64)
    out[pc.sort_indices(ids).to_numpy(zero_copy_only=False)] = np.arange(len(ids))
    return out


def _same_ids(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the ids of the two sides are (ids of different types: as text)."""
    if a.type != b.type:
        a, b = pc.cast(a, pa.string()), pc.cast(b, pa.string())
    both = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return both[:len(a)], both[len(a):]


def _cell(k: int, cos: bool, ignore_identical: bool, tie: str, names: list[str]):
    """Hits of one cell: (queries, corpus) as Arrow tables -> the k best per query."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qids, dids = left.column("qid").combine_chunks(), right.column("docid").combine_chunks()
        nq, nd = len(qids), len(dids)
        rows, cols, scores = [], [], []
        if nq and nd:
            qm, dm = _matrix(left.column("qv"), nq), _matrix(right.column("dv"), nd)
            if qm.shape[1] != dm.shape[1]:
                raise ValueError(f"vectors of different lengths: {qm.shape[1]} and {dm.shape[1]}")
            if cos:
                qm, dm = _normalize(qm), _normalize(dm)
            code = _codes(pc.cast(dids, pa.string()) if tie == "string" else dids)
            at = np.argsort(code)
            same = _same_ids(qids, dids) if ignore_identical else None
            for lo in range(0, nq, TILE[0]):
                q = qm[lo:lo + TILE[0]]
                best_s, best_i = np.zeros((len(q), 0)), np.zeros((len(q), 0), dtype=np.int64)
                for first in range(0, nd, TILE[1]):
                    s = np.round(q @ dm[first:first + TILE[1]].T, 9)
                    s[np.isnan(s)] = -1.0
                    if same is not None:
                        s[same[0][lo:lo + len(q), None] == same[1][None, first:first + TILE[1]]] = -np.inf
                    bs, bi, _ = _block_top(s, code[first:first + TILE[1]], k)
                    best_s, best_i, _ = _merge(best_s, best_i, bs, bi, k)
                row, col = np.nonzero(best_s > -np.inf)
                rows.append(row + lo)
                cols.append(at[best_i[row, col]])
                scores.append(best_s[row, col])
        row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        col = pa.array(np.concatenate(cols) if cols else np.zeros(0, np.int64))
        made = {"qid": lambda: qids.take(row), "docid": lambda: dids.take(col),
                "score": lambda: pa.array(np.concatenate(scores) if scores else np.zeros(0)),
                "qpayload": lambda: left.column("qp").combine_chunks().take(row),
                "dpayload": lambda: right.column("dp").combine_chunks().take(col)}
        return pa.table([made[n]() for n in names], names=names)
    return run


def rank_top_k(cands: DataFrame, k: int, key: str = "qid", tie: str = "id") -> DataFrame:
    """W1/V5 final cut: rank by score desc, docid desc (``tie="string"``: the docid as text); keep
    rank <= k (window group limit)."""
    last = F.col("docid").cast("string") if tie == "string" else F.col("docid")
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), last.desc())
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merge_top_k(parts: list[DataFrame], k: int, tie: str = "id") -> DataFrame:
    """V5: merge partial top-k lists; a hit listed twice counts once (decision R1)."""
    u = parts[0].select("qid", "docid", "score")
    for p in parts[1:]:
        u = u.unionByName(p.select("qid", "docid", "score"))
    u = u.groupBy("qid", "docid").agg(F.max("score").alias("score"))
    return rank_top_k(u, k, tie=tie)


def vector_blocks(df: DataFrame, vec: str, chunk_bytes: int | None = None, across: int | None = None) -> int:
    """Blocks of at most ``chunk_bytes`` (or the session setting ``spark.nluscore.topk.chunkBytes``, default 8 MB) that hold the
    vectors as doubles; with ``across``, the blocks of the other side, also enough blocks of BLOCK_ROWS rows for a cell per
    shuffle partition. Both sides are cut alike, so repeats grow by the root of the cells."""
    conf = df.sparkSession.conf
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.col(vec))).alias("dim")).first()
    n, dim = int(stats["n"]), max(int(stats["dim"] or 0), 1)
    budget = chunk_bytes or int(conf.get("spark.nluscore.topk.chunkBytes", str(DEFAULT_CHUNK_BYTES)))
    blocks = max(1, math.ceil(n * dim * 8 / budget))
    if across:
        blocks = max(blocks, min(math.ceil(int(conf.get("spark.sql.shuffle.partitions")) / across), math.ceil(n / BLOCK_ROWS)))
    return blocks


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 100, qid: str = "qid", docid: str = "docid",
          vec: str = "embedding", qvec: str | None = None, metric: str = "cos_sim",
          ignore_identical: bool = False, chunk_bytes: int | None = None,
          qpayload: str | None = None, dpayload: str | None = None, tie: str = "id",
          query_blocks: int | None = None) -> DataFrame:
    """V4: exact top-k per query -> ``(qid, docid, score, rank[, qpayload][, dpayload])``.

    Ids may have any type and keep it. Scores are rounded to 9 digits before ranking so equal vectors tie; ties are broken
    by the greater id, with ``tie="string"`` by the greater id as text (the order of trec evaluations). NaN
    scores become -1. Rows with a null id take no part. ``qpayload`` / ``dpayload``: a column of either side emitted
    with every hit, so e.g. a label can decide relevance without a join. ``query_blocks``: blocks of the query side
    where they are known (otherwise counted).
    """
    if metric not in ("cos_sim", "dot"):
        raise ValueError(f"metric must be cos_sim or dot, not {metric!r}")
    if tie not in ("id", "string"):
        raise ValueError(f"tie must be id or string, not {tie!r}")
    pay_q = [F.col(qpayload).alias("qp")] if qpayload else []
    pay_d = [F.col(dpayload).alias("dp")] if dpayload else []
    q = queries.filter(F.col(qid).isNotNull()).select(F.col(qid).alias("qid"), F.col(qvec or vec).alias("qv"), *pay_q)
    d = corpus.filter(F.col(docid).isNotNull()).select(F.col(docid).alias("docid"), F.col(vec).alias("dv"), *pay_d)
    nq = query_blocks or vector_blocks(q, "qv", chunk_bytes)
    nd = vector_blocks(d, "dv", chunk_bytes, across=nq)
    q = q.withColumn("cell", F.explode(F.sequence(F.pmod(F.xxhash64("qid", "qv"), F.lit(nq)) * nd, F.pmod(F.xxhash64("qid", "qv"), F.lit(nq)) * nd + (nd - 1))))
    d = d.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(nq - 1)), lambda i: i * nd + F.pmod(F.xxhash64("docid", "dv"), F.lit(nd)))))
    kinds = {"qid": ("qid", q), "docid": ("docid", d), "qpayload": ("qp", q), "dpayload": ("dp", d)}
    names = ["qid", "docid", "score"] + (["qpayload"] if qpayload else []) + (["dpayload"] if dpayload else [])
    schema = T.StructType([T.StructField(n, T.DoubleType() if n == "score" else kinds[n][1].schema[kinds[n][0]].dataType) for n in names])
    hits = (q.groupBy("cell").cogroup(d.groupBy("cell"))
             .applyInArrow(_cell(k, metric == "cos_sim", ignore_identical, tie, names), schema))
    return rank_top_k(hits, k, tie=tie)


def pool_tokens(df: DataFrame, tokens: str, mask_len: str | None, how: str, out: str = "pooled", mask: str | None = None) -> DataFrame:
    """V6: pool ``array<array<float>>`` token vectors; attended are the first ``mask_len`` tokens, or those of ``mask``, an
    array of one number (0 or 1, or any weight) per token, in any places.

    first_token (whatever the mask), last_token (the one before the first 0 of the mask; the last without a 0;
    the first where the mask begins with 0), mean (masked), weightedmean (weights pos+1). Pure
    higher-order functions: no explode, no shuffle.
    """
    t = F.col(tokens)
    size = F.size(t)
    dims = F.sequence(F.lit(0), F.size(F.element_at(t, 1)) - 1)
    if mask is not None:
        m = F.col(mask)
        w_at = lambda i: F.coalesce(F.get(m, i).cast("double"), F.lit(0.0))
        first_zero = F.array_position(F.transform(m, lambda x: x.cast("double")), 0.0).cast("int")
        last = F.when(first_zero > 0, first_zero - 1).otherwise(size)
    else:
        n = F.least(F.col(mask_len).cast("int"), size)
        w_at = lambda i: (i < n).cast("double")
        last = n

    def total(weight):
        return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0.0), lambda a, i: a + weight(i))

    def wsum(weight):
        return F.transform(dims, lambda d: F.aggregate(
            F.transform(t, lambda tok, i: weight(i) * F.element_at(tok, d + 1).cast("double")),
            F.lit(0.0), lambda a, x: a + x))

    floor = F.lit(1e-9)
    if how == "first_token":
        res = F.transform(F.element_at(t, 1), lambda x: x.cast("double"))
    elif how == "last_token":
        at = F.greatest(last, F.lit(1))
        scale = w_at(at - 1) if mask is not None else F.lit(1.0)
        res = F.transform(F.element_at(t, at), lambda x: x.cast("double") * scale)
    elif how == "mean":
        res = F.transform(wsum(w_at), lambda x: x / F.greatest(total(w_at), floor))
    elif how == "weightedmean":
        # the mask weighs the states and, with the position, their sum
        res = F.transform(wsum(lambda i: w_at(i) * w_at(i) * (i + 1)), lambda x: x / F.greatest(total(lambda i: w_at(i) * (i + 1)), floor))
    else:
        raise ValueError(f"unknown pooling {how!r}")
    return df.withColumn(out, res)


def _lse_cell(scale: float, cos: bool):
    """Of one block of queries against one block of docs: per query the greatest scaled score, the sum of exponentials
    over it, and the scaled score of its paired doc where the block has it."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nq, nd = left.num_rows, right.num_rows
        top, total, pair = np.zeros(nq), np.zeros(nq), np.full(nq, np.nan)
        if nq and nd:
            qm, dm = _matrix(left.column("v"), nq), _matrix(right.column("v"), nd)
            if cos:
                qm, dm = _normalize(qm), _normalize(dm)
            s = scale * (qm @ dm.T)
            top = s.max(axis=1)
            total = np.exp(s - top[:, None]).sum(axis=1)
            place, doc = _same_ids(left.column("pos").combine_chunks(), right.column("docid").combine_chunks())
            at = {int(c): k for k, c in enumerate(doc)}
            k = np.array([at.get(int(p), -1) if p == p else -1 for p in place])
            pair = np.where(k >= 0, s[np.arange(nq), np.maximum(k, 0)], np.nan)
        has = np.full(nq, bool(nd))
        return pa.table({"batch_id": left.column("batch_id"), "qid": left.column("qid"), "top": pa.array(top, mask=~has),
                         "total": pa.array(total, mask=~has), "pair": pa.array(pair, mask=np.isnan(pair))})
    return run


def contrastive_loss(queries: DataFrame, docs: DataFrame, batch: str = "batch_id", qid: str = "qid",
                     pos: str = "pos_docid", docid: str = "docid", vec: str = "embedding",
                     scale: float = 20.0, metric: str = "cos_sim", reduction: str = "none",
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """In-batch softmax cross-entropy of each query's paired doc among the docs of its batch.

    loss = logsumexp(scale*s) - scale*s_pos; null when the batch lacks the paired doc. ``reduction``: "none" gives
    ``(batch_id, qid, loss)``, "mean" and "sum" ``(batch_id, loss)`` over the batch's queries. A batch may have any
    size: queries and docs are cut into blocks of ``block_rows`` by a hash, every pair of blocks is one matrix product that
    leaves a mergeable part of the log-sum-exp per query, and the parts are merged by an aggregation.
    """
    if reduction not in ("none", "mean", "sum"):
        raise ValueError(f"reduction must be none, mean or sum, not {reduction!r}")
    q = queries.select(F.col(batch).cast("long").alias("batch_id"), F.col(qid).cast("long").alias("qid"),
                       F.col(pos).cast("long").alias("pos"), F.col(vec).alias("v"))
    d = docs.select(F.col(batch).cast("long").alias("batch_id"), F.col(docid).cast("long").alias("docid"),
                    F.col(vec).alias("v"))

    def blocks(side: DataFrame, out: str) -> DataFrame:
        return side.groupBy("batch_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias(out))

    sizes = blocks(q, "nq").join(blocks(d, "nd"), "batch_id", "left").withColumn("nd", F.coalesce("nd", F.lit(1).cast("long")))
    q = q.join(sizes, "batch_id").withColumn("qb", F.pmod(F.xxhash64("qid"), "nq")).withColumn("db", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nd") - 1)))
    d = d.join(sizes, "batch_id").withColumn("db", F.pmod(F.xxhash64("docid"), "nd")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
    keys = ["batch_id", "qb", "db"]
    parts = (q.select(*keys, "qid", "pos", "v").groupBy(*keys).cogroup(d.select(*keys, "docid", "v").groupBy(*keys))
              .applyInArrow(_lse_cell(scale, metric == "cos_sim"), "batch_id long, qid long, top double, total double, pair double"))
    merged = parts.groupBy("batch_id", "qid").agg(F.collect_list(F.struct("top", "total")).alias("_p"), F.max("pair").alias("_pair"), F.max("top").alias("_top"))
    # one part per block of docs: their number, not the batch's, bounds the list
    lse = F.col("_top") + F.log(F.aggregate("_p", F.lit(0.0), lambda a, x: a + F.coalesce(x["total"] * F.exp(x["top"] - F.col("_top")), F.lit(0.0))))
    each = merged.select("batch_id", "qid", (lse - F.col("_pair")).alias("loss"))
    if reduction == "none":
        return each
    return each.groupBy("batch_id").agg((F.avg if reduction == "mean" else F.sum)("loss").alias("loss"))
