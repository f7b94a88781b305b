"""Distributed operators against brute force: prefix sums, row ids, top-k, pooling, contrastive."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nluscore.operators import prefix as W
from nluscore.operators import vectors as V


def test_prefix_sum_equals_cumsum(spark):
    rng = np.random.default_rng(0)
    vals = rng.integers(-5, 9, 500)
    df = spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(vals)], "k long, v long").repartition(7)
    got = [r["c"] for r in W.prefix_sum(df, ["k"], "v", "c", parts=5).orderBy("k").collect()]
    assert got == list(np.cumsum(vals))


def test_prefix_sum_by_key_restarts(spark):
    rows = [(g, i, float(i % 3)) for g in range(4) for i in range(50)]
    df = spark.createDataFrame(rows, "g long, k long, v double")
    got = {(r["g"], r["k"]): r["c"] for r in W.prefix_sum(df, ["k"], "v", "c", by="g", parts=6).collect()}
    for g in range(4):
        run = 0.0
        for i in range(50):
            run += i % 3
            assert got[(g, i)] == run


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10_000), min_size=1, max_size=200, unique=True))
def test_row_ids_dense_in_order(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = W.with_row_id(df, ["k"], "rid", parts=4).collect()
    assert sorted((r["k"], r["rid"]) for r in got) == [(k, i) for i, k in enumerate(sorted(keys))]


def brute_topk(q, qid, c, cid, k, ignore):
    qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    cn = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    s = np.round(qn @ cn.T, 9)
    s[np.isnan(s)] = -1
    out = []
    for i, a in enumerate(qid):
        items = [(s[i, j], b) for j, b in enumerate(cid) if not (ignore and a == b)]
        items.sort(key=lambda t: (-t[0], -t[1]))
        out += [(int(a), int(b), round(float(sc), 6), r + 1) for r, (sc, b) in enumerate(items[:k])]
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes", [64 << 20, 2_000])
def test_top_k_equals_brute_force_with_ties(spark, chunk_bytes):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(120, 8))
    c[10] = c[11] = c[12]          # exact duplicates tie
    c[20] = 0.0                    # zero vector
    ids = np.arange(120)
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, c)], "id long, v array<double>")
    got = V.top_k(df.filter("id % 3 = 0"), df.repartition(5), k=7, qid="id", docid="id", vec="v",
                  ignore_identical=True, chunk_bytes=chunk_bytes)
    got = sorted((r["qid"], r["docid"], round(r["score"], 6), r["rank"]) for r in got.collect())
    assert got == brute_topk(c[ids % 3 == 0], ids[ids % 3 == 0], c, ids, 7, True)


def test_merge_top_k_dedupes(spark):
    a = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.8)], "qid long, docid long, score double")
    got = V.merge_top_k([a, a], 3).collect()
    assert sorted((r["docid"], r["rank"]) for r in got) == [(5, 1), (6, 2)]


def test_pool_tokens_matches_numpy(spark):
    rng = np.random.default_rng(2)
    toks = rng.normal(size=(3, 5, 4))
    masks = [1, 3, 5]
    df = spark.createDataFrame([(i, t.tolist(), m) for i, (t, m) in enumerate(zip(toks, masks))],
                               "id int, t array<array<double>>, m int")
    for how in ("first_token", "last_token", "mean", "weightedmean"):
        got = {r["id"]: np.array(r["pooled"]) for r in V.pool_tokens(df, "t", "m", how).collect()}
        for i, (t, m) in enumerate(zip(toks, masks)):
            w = np.arange(1, m + 1)[:, None]
            want = {"first_token": t[0], "last_token": t[m - 1], "mean": t[:m].mean(0),
                    "weightedmean": (t[:m] * w).sum(0) / w.sum()}[how]
            assert np.allclose(got[i], want)


def test_contrastive_loss_matches_numpy(spark):
    rng = np.random.default_rng(4)
    q, d = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    qdf = spark.createDataFrame([(i // 3, i, 100 + i, q[i].tolist()) for i in range(6)],
                                "b long, qid long, pos long, v array<double>")
    ddf = spark.createDataFrame([(i // 3, 100 + i, d[i].tolist()) for i in range(6)], "b long, docid long, v array<double>")
    got = {r["qid"]: r["loss"] for r in V.contrastive_loss(qdf, ddf, "b", "qid", "pos", "docid", "v", 20.0).collect()}
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    dn = d / np.linalg.norm(d, axis=1, keepdims=True)
    for i in range(6):
        b = i // 3
        s = 20 * qn[i] @ dn[3 * b:3 * b + 3].T
        want = np.log(np.exp(s).sum()) - s[i - 3 * b]
        assert abs(got[i] - want) < 1e-9


def test_borrow_negatives_positions_and_sources(spark):
    from nluscore.operators import tuples as X
    # labels 0..2; label 2 has a single member, so instances pointing at it lack negatives
    rows = [(i, i % 3 if i < 9 else 2) for i in range(10)]
    e = spark.createDataFrame(rows, "vec_id long, label int").filter("vec_id < 9 or label = 2")
    e = e.filter(~((F.col("label") == 2) & (F.col("vec_id") != 2)))   # label 2 = {2}
    members = X.index_members(e, "label", "vec_id", "vec_id")
    inst = members.select(F.col("_item").alias("q"), F.col("label").alias("pg"), F.col("idx").alias("si"),
                          F.when(F.col("label") == 0, 2).otherwise(0).alias("ng"))
    got = X.borrow_negatives(inst, members, "q", "pg", "ng", "si", 3, 1, 42).collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r["q"], []).append((r["position"], r["negative"]))
    # label-0 instances have one own negative (vec 2) at position 1 and borrow the rest
    for q, lst in by_q.items():
        lst.sort()
        assert [p for p, _ in lst] == list(range(1, len(lst) + 1)) and len(lst) <= 3
        assert lst[0][1] == 2


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_segmented_prefix_sum_hot_and_small_keys(spark, parts):
    rng = np.random.default_rng(7)
    rows = [("hot", 1, i, int(rng.integers(0, 5))) for i in range(300)]          # one key with most rows
    rows += [(f"k{j}", j % 2, i, int(rng.integers(0, 5))) for j in range(40) for i in range(j % 4 + 1)]
    df = spark.createDataFrame(rows, "g string, h int, k long, v long").repartition(4)
    got = {(r["g"], r["h"], r["k"]): r["c"] for r in W.prefix_sum(df, ["k"], "v", "c", by=["g", "h"], parts=parts).collect()}
    import pandas as pd
    p = pd.DataFrame(rows, columns=["g", "h", "k", "v"]).sort_values(["g", "h", "k"])
    p["c"] = p.groupby(["g", "h"])["v"].cumsum()
    assert got == {(a, b, c): int(d) for a, b, c, d in zip(p.g, p.h, p.k, p.c)}
    ids = {(r["g"], r["h"], r["k"]): r["rid"] for r in W.with_row_id(df, ["k"], "rid", by=["g", "h"], parts=parts).collect()}
    p["rid"] = p.groupby(["g", "h"]).cumcount()
    assert ids == {(a, b, c): int(d) for a, b, c, d in zip(p.g, p.h, p.k, p.rid)}


def test_block_top_matches_full_sort_with_ties():
    from nluscore.operators.vectors import _block_top, _merge
    rng = np.random.default_rng(11)
    for _ in range(100):
        nq, n, k = int(rng.integers(1, 6)), int(rng.integers(1, 40)), int(rng.integers(1, 8))
        s = np.round(rng.integers(0, 4, size=(nq, n)) / 3, 9).astype(float)
        s[rng.random((nq, n)) < 0.1] = -np.inf
        ids = rng.permutation(1000)[:n].astype(np.int64)
        a = _block_top(s, ids, k)
        b = _merge(np.zeros((nq, 0)), np.zeros((nq, 0), np.int64), s, ids, k)
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_vector_column_functions(spark):
    from nluscore.functions import vectors as FV
    a, b = [3.0, 4.0, 0.0], [1.0, 0.0, 1.0]
    df = spark.createDataFrame([(a, b, [0.0, 0.0, 0.0], float("nan"))], "a array<double>, b array<double>, z array<double>, s double")
    r = df.select(FV.l2_normalize("a").alias("n"), FV.dot("a", "b").alias("d"), FV.cosine("a", "b").alias("c"),
                  FV.l2_normalize("z").alias("zn"), FV.nan_to("s").alias("s")).first()
    assert np.allclose(r["n"], [0.6, 0.8, 0.0]) and r["d"] == 3.0 and r["zn"] == [0.0, 0.0, 0.0] and r["s"] == -1.0
    assert abs(r["c"] - 3.0 / (5.0 * np.sqrt(2.0))) < 1e-12
    assert FV.cutoffs(10) == [1, 3, 5, 10] and FV.cutoffs(20) == [1, 3, 5, 10, 20]


def test_top_k_payloads_and_null_labels(spark):
    rng = np.random.default_rng(9)
    c = rng.normal(size=(30, 5))
    labels = [None if i % 7 == 0 else i % 3 for i in range(30)]
    df = spark.createDataFrame([(i, [float(x) for x in v], lab) for i, (v, lab) in enumerate(zip(c, labels))],
                               "id long, v array<double>, label int")
    h = V.top_k(df, df, k=4, qid="id", docid="id", vec="v", ignore_identical=True, qpayload="label", dpayload="label")
    plain = {(r["qid"], r["docid"], r["rank"]) for r in V.top_k(df, df, k=4, qid="id", docid="id", vec="v",
                                                                   ignore_identical=True).collect()}
    rows = h.collect()
    assert {(r["qid"], r["docid"], r["rank"]) for r in rows} == plain
    for r in rows:
        assert r["qpayload"] == labels[r["qid"]] and r["dpayload"] == labels[r["docid"]]
