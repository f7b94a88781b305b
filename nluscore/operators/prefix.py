"""Distributed prefix sums and dense global ranks (I1), never through one partition.

Plan: range-partition on the order key, sort inside partitions, checkpoint to the shared folder
(range bounds come from sampling, so a recomputation could move rows), collect one total per
partition (a few hundred numbers), then add each partition's offset while streaming its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .metrics_table import as_list


def _num_parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _range_sorted(df: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    n = parts or _num_parts(df)
    cols = [F.col(k).asc_nulls_first() for k in keys]
    # range bounds are sampled by a first job; keep the input for the checkpoint job so it is
    # computed once, and release it as soon as the checkpoint has cut the lineage
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cut_lineage(src.repartitionByRange(n, *cols).sortWithinPartitions(*cols))
    finally:
        src.unpersist()


def _offsets(rp: DataFrame, values: list[str] | None) -> dict[int, list]:
    if values is None:
        aggs = [F.count(F.lit(1)).alias("t0")]
    else:
        aggs = [F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"t{i}") for i, v in enumerate(values)]
    rows = rp.groupBy(F.spark_partition_id().alias("pid")).agg(*aggs).collect()
    width = len(aggs)
    totals = {r["pid"]: [r[f"t{i}"] or 0 for i in range(width)] for r in rows}
    out, run = {}, [0] * width
    for pid in sorted(totals):
        out[pid] = list(run)
        run = [a + b for a, b in zip(run, totals[pid])]
    return out


def _boundaries(pdf: pd.DataFrame, by: list[str]) -> np.ndarray:
    """True where a row starts a new key (rows are sorted by key); nulls equal nulls."""
    n = len(pdf)
    change = np.zeros(n, dtype=bool)
    if n:
        change[0] = True
    for c in by:
        a = pdf[c].to_numpy()
        na = pd.isna(a)
        diff = (a[1:] != a[:-1]) & ~(na[1:] & na[:-1])
        change[1:] |= np.asarray(diff, dtype=bool)
    return change


def _same(a, b) -> bool:
    if a is None or b is None:
        return False
    return all((x == y) or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def _segmented(rp: DataFrame, by: list[str], values: list[str], outs: list[str], integral: list[bool]) -> DataFrame:
    """Prefix sums restarting at every key of the (range-partitioned, sorted) input, without a join:
    one summary row per partition gives each partition's carry-in for its first key."""
    dtypes = [np.int64 if it else np.float64 for it in integral]
    key_fields = [rp.schema[c] for c in by]
    vtype = [T.LongType() if it else T.DoubleType() for it in integral]
    sschema = T.StructType(
        [T.StructField("pid", T.IntegerType())]
        + [T.StructField(f"_f_{f.name}", f.dataType, True) for f in key_fields]
        + [T.StructField(f"_l_{f.name}", f.dataType, True) for f in key_fields]
        + [T.StructField(f"_fs{i}", t, True) for i, t in enumerate(vtype)]
        + [T.StructField(f"_ls{i}", t, True) for i, t in enumerate(vtype)]
        + [T.StructField("_single", T.BooleanType(), True)])

    def arrays(pdf):
        return [pdf[v].fillna(0).to_numpy(dtype=d) for v, d in zip(values, dtypes)]

    def summarize(batches):
        pid = TaskContext.get().partitionId()
        first = last = None
        fsum = lsum = None
        first_open = True
        for pdf in batches:
            if not len(pdf):
                continue
            ch = _boundaries(pdf, by)
            starts = np.flatnonzero(ch)
            vals = arrays(pdf)
            sums = [np.add.reduceat(v, starts) for v in vals]
            k0 = tuple(pdf[c].iat[0] for c in by)
            kl = tuple(pdf[c].iat[len(pdf) - 1] for c in by)
            s0 = np.array([x[0] for x in sums])
            sl = np.array([x[-1] for x in sums])
            if first is None:
                first, fsum, last, lsum = k0, s0.copy(), k0, s0.copy()
            elif _same(k0, last):
                lsum = lsum + s0
                if first_open:
                    fsum = fsum + s0
            else:
                first_open = False
                last, lsum = k0, s0.copy()
            if len(starts) > 1:
                first_open = False
                last, lsum = kl, sl.copy()
        if first is None:
            return
        row = {"pid": [pid]}
        for c, a, b in zip(by, first, last):
            row[f"_f_{c}"], row[f"_l_{c}"] = [a], [b]
        for i in range(len(values)):
            row[f"_fs{i}"], row[f"_ls{i}"] = [fsum[i]], [lsum[i]]
        row["_single"] = [bool(first_open)]
        yield pd.DataFrame(row)

    summ = sorted(rp.mapInPandas(summarize, sschema).collect(), key=lambda r: r["pid"])
    nv = len(values)
    zero = [0] * nv
    carry: dict[int, tuple] = {}
    cur, run = None, list(zero)
    for r in summ:
        fk = tuple(r[f"_f_{c}"] for c in by)
        lk = tuple(r[f"_l_{c}"] for c in by)
        fs = [r[f"_fs{i}"] or 0 for i in range(nv)]
        ls = [r[f"_ls{i}"] or 0 for i in range(nv)]
        c_in = list(run) if _same(fk, cur) else list(zero)
        carry[r["pid"]] = (fk, c_in)
        if r["_single"]:
            cur, run = fk, [a + b for a, b in zip(c_in, fs)]
        else:
            cur, run = lk, ls

    schema = T.StructType(rp.schema.fields + [T.StructField(o, t, True) for o, t in zip(outs, vtype)])

    def run_sum(batches):
        pid = TaskContext.get().partitionId()
        ckey, cval = carry.get(pid, (None, [0] * len(values)))
        for pdf in batches:
            if not len(pdf):
                yield pdf.assign(**{o: pd.Series(dtype=d) for o, d in zip(outs, dtypes)})
                continue
            ch = _boundaries(pdf, by)
            starts = np.flatnonzero(ch)
            lens = np.diff(np.append(starts, len(pdf)))
            k0 = tuple(pdf[c].iat[0] for c in by)
            cont = _same(k0, ckey)
            for i, (v, o) in enumerate(zip(arrays(pdf), outs)):
                tot = np.cumsum(v)
                base = np.repeat((tot - v)[starts], lens)
                cs = tot - base
                if cont:
                    cs[: lens[0]] += dtypes[i](cval[i])
                pdf[o] = cs.astype(dtypes[i])
            ckey = tuple(pdf[c].iat[len(pdf) - 1] for c in by)
            cval = [pdf[o].iat[len(pdf) - 1] for o in outs]
            yield pdf

    return rp.mapInPandas(run_sum, schema)


def prefix_sum(df: DataFrame, order: Sequence[str], value, out, by=None,
               parts: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` (one name or a list) in ``order``, restarting per ``by`` key.

    ``order`` must make rows unique within a key, otherwise tie order is unspecified. With ``by`` the
    sums restart at key boundaries inside the range partitions, and a key spanning partitions gets
    its carry-in from one summary row per partition: no join, no shuffle beyond the range partition.
    """
    by, order = as_list(by), list(order)
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    rp = _range_sorted(df, by + order, parts)
    types = dict(rp.dtypes)
    integral = [types[v] in ("tinyint", "smallint", "int", "bigint") for v in values]
    if by:
        return _segmented(rp, by, values, outs, integral)
    offsets = _offsets(rp, values)
    schema = T.StructType(rp.schema.fields + [
        T.StructField(o, T.LongType() if it else T.DoubleType(), True) for o, it in zip(outs, integral)])

    def run_sum(batches):
        pid = TaskContext.get().partitionId()
        run = list(offsets.get(pid, [0] * len(values)))
        for pdf in batches:
            for i, (v, o) in enumerate(zip(values, outs)):
                arr = pdf[v].fillna(0).to_numpy(dtype=np.int64 if integral[i] else np.float64)
                cs = np.cumsum(arr) + run[i]
                if len(cs):
                    run[i] = cs[-1]
                pdf[o] = cs
            yield pdf

    return rp.mapInPandas(run_sum, schema)


def with_row_id(df: DataFrame, order: Sequence[str], out: str = "row_id", by=None,
                parts: int | None = None) -> DataFrame:
    """Dense 0-based row ids in ``order`` (per ``by`` key).

    Without a key: JVM only — within a checkpointed partition ``monotonically_increasing_id`` is
    ``pid << 33 | row``, so the id is the partition's offset plus the row's place inside it.
    With a key: a segmented count (see ``prefix_sum``), so hot keys stay spread and nothing is joined.
    """
    by, order = as_list(by), list(order)
    if by:
        x = df.withColumn("_one", F.lit(1).cast("long"))
        r = prefix_sum(x, order, "_one", out, by, parts)
        return r.withColumn(out, F.col(out) - 1).drop("_one")
    rp = _range_sorted(df, order, parts)
    offsets = _offsets(rp, None)
    spark = df.sparkSession
    off = spark.createDataFrame([(int(p), int(o[0])) for p, o in offsets.items()], "pid int, off long")
    mono = F.monotonically_increasing_id()
    tagged = rp.select("*", F.spark_partition_id().alias("_pid"),
                       (mono - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("_local"))
    return (tagged.join(F.broadcast(off), tagged["_pid"] == off["pid"], "inner")
                  .withColumn(out, F.col("off") + F.col("_local")).drop("_pid", "_local", "pid", "off"))


def neighbour_values(df: DataFrame, order: Sequence[str], wanted: dict, by=None, parts: int | None = None) -> DataFrame:
    """For every row, values of the nearest earlier or later row of its ``by`` key in ``order`` that meets a condition.

    ``wanted``: output name -> (column, -1 or +1, condition or None); null where there is no such row. One range partition on
    (by, order), so a hot key is spread over tasks; what a partition's rows need from beyond it is carried in from one
    summary row per partition (the first and last matching values of its edge keys). No join, no window over a key.
    A task holds its partition once more while it looks ahead.
    """
    by, order = as_list(by), list(order)
    outs = list(wanted)
    work = df.select("*", *(F.col(c).alias(f"_v{i}") for i, (c, _, _) in enumerate(wanted.values())),
                     *((cond if cond is not None else F.lit(True)).alias(f"_c{i}") for i, (_, _, cond) in enumerate(wanted.values())))
    rp = _range_sorted(work, by + order, parts)
    n, signs = len(outs), [d for _, d, _ in wanted.values()]
    kinds = [rp.schema[f"_v{i}"].dataType for i in range(n)]

    def segments(t: pa.Table) -> np.ndarray:
        """Number of the key's stretch each row is in."""
        new = np.zeros(t.num_rows, dtype=bool)
        for c in by:
            codes = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            codes = np.where(np.isnan(codes), -1, codes) if codes.dtype.kind == "f" else codes
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    def nearest(seg: np.ndarray, ok: np.ndarray, sign: int) -> np.ndarray:
        """Row of the nearest match before or behind each row inside its stretch, -1 without one."""
        if sign > 0:
            back = nearest(seg[::-1] * -1, ok[::-1], -1)[::-1]
            return np.where(back >= 0, len(ok) - 1 - back, -1)
        last = np.maximum.accumulate(np.where(ok, np.arange(len(ok)), -1))
        before = np.concatenate(([-1], last[:-1]))
        return np.where((before >= 0) & (seg[before] == seg), before, -1)

    def matching(t: pa.Table, i: int) -> np.ndarray:
        return t.column(f"_c{i}").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)

    edge = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("single", T.BooleanType())]
                        + [T.StructField(f"{e}{j}", rp.schema[c].dataType) for e in ("f", "l") for j, c in enumerate(by)]
                        + [f for i in range(n) for f in (T.StructField(f"h{i}", T.BooleanType()), T.StructField(f"v{i}", kinds[i]))])

    def summary(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        seg = segments(t)
        row = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([bool(seg[-1] == 0)])]
        row += [t.column(c).combine_chunks().slice(at, 1) for at in (0, t.num_rows - 1) for c in by]
        for i, sign in enumerate(signs):
            own = np.flatnonzero(matching(t, i) & (seg == (seg[-1] if sign < 0 else 0)))
            at = (own[-1] if sign < 0 else own[0]) if len(own) else 0
            row += [pa.array([bool(len(own))]), t.column(f"_v{i}").combine_chunks().slice(int(at), 1)]
        yield pa.RecordBatch.from_arrays(row, names=edge.fieldNames())

    edges = sorted((r.asDict(recursive=True) for r in rp.mapInArrow(summary, edge).collect()), key=lambda r: r["pid"])
    first, last = [f"f{j}" for j in range(len(by))], [f"l{j}" for j in range(len(by))]
    carry: dict[int, list] = {r["pid"]: [None] * n for r in edges}
    for i, sign in enumerate(signs):
        key, value = None, None  # of the stretch that the neighbouring partitions end with
        near, far = (first, last) if sign < 0 else (last, first)
        for r in edges if sign < 0 else edges[::-1]:
            same = key is not None and key == [r[c] for c in near]
            carry[r["pid"]][i] = value if same else None
            if r[f"h{i}"]:
                value = (r[f"v{i}"],)
            elif not (same and r["single"]):
                value = None
            key = [r[c] for c in far]
    schema = T.StructType(df.schema.fields + [T.StructField(o, k) for o, k in zip(outs, kinds)])
    names = df.columns

    def fill(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        seg, cols = segments(t), [t.column(c).combine_chunks() for c in names]
        for i, sign in enumerate(signs):
            at, values = nearest(seg, matching(t, i), sign), t.column(f"_v{i}").combine_chunks()
            from_beyond = carry[TaskContext.get().partitionId()][i]
            if from_beyond is not None:
                values = pa.concat_arrays([values, pa.array([from_beyond[0]], values.type)])
                at = np.where((at < 0) & (seg == (0 if sign < 0 else seg[-1])), len(seg), at)
            cols.append(values.take(pa.array(np.maximum(at, 0), mask=at < 0)))
        whole = pa.Table.from_arrays(cols, names=[*names, *outs])
        yield from whole.to_batches(max_chunksize=8192)

    return rp.mapInArrow(fill, schema)


def average_ranks(df: DataFrame, col: str, by=None, out: str = "rank") -> DataFrame:
    """1-based ranks of ``col`` with ties sharing their mean rank (per ``by`` key); nulls get null.

    Values are counted, ranked with the distributed prefix sum and joined back with a shuffle join
    (AQE splits hot values). Keys are matched null-safely: a null ``by`` key is a group of its own.
    """
    by = as_list(by)
    vc = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_cnt"))
    ps = prefix_sum(vc, [col], "_cnt", "_cum", by)
    keys = [*by, col]
    ranks = ps.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
                      (F.col("_cum") - F.col("_cnt") + (F.col("_cnt") + 1) / 2.0).alias(out))
    same = [df[k].eqNullSafe(ranks[f"_k{i}"]) for i, k in enumerate(by)] + [df[col] == ranks[f"_k{len(by)}"]]
    return df.join(ranks, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def dense_rank_global(df: DataFrame, col: str, out: str = "dense_rank") -> DataFrame:
    """0-based dense rank of the distinct values of ``col`` (distinct first, then I1)."""
    d = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return with_row_id(d, [col], out)
