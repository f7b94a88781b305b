"""Mergeable user metrics, block-wise contrastive loss and pooling with real masks against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nluscore.operators import registry as G
from nluscore.operators import vectors as V


def median_parts():
    """A sketch-like state that no Column aggregate gives: all values, sorted at the end."""
    return (list, lambda s, f: s + f["v"].dropna().tolist(), lambda a, b: a + b,
            lambda s: {"median": float(np.median(s)) if s else None, "n": len(s)})


@pytest.mark.parametrize("parts,held", [(1, 4096), (7, 4096), (5, 2)])
def test_custom_metric_states_of_hot_rare_and_null_keys(spark, parts, held):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.normal(size=700)] + [(f"k{i % 40}", float(i)) for i in range(200)] + [(None, 1.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    got = {r["k"]: (r["median"], r["n"]) for r in G.custom_metric_states(df, *median_parts(), "median double, n long", by="k", held=held).collect()}
    for k in {k for k, _ in rows}:
        v = [x for q, x in rows if q == k and x is not None]
        assert got.pop(k) == ((pytest.approx(np.median(v)) if v else None), len(v))
    assert not got
    whole = G.custom_metric_states(df, *median_parts(), "median double, n long").collect()
    assert len(whole) == 1 and whole[0]["n"] == 902
    assert G.custom_metric_states(df.limit(0), *median_parts(), "median double, n long", by="k").count() == 0


@pytest.mark.parametrize("block_rows", [3, 10, 4096])
@pytest.mark.parametrize("metric", ["cos_sim", "dot"])
def test_contrastive_loss_of_any_batch_size(spark, block_rows, metric):
    rng = np.random.default_rng(6)
    sizes = {0: (31, 40), 1: (1, 1), 2: (2, 9)}
    q = [(b, 100 * b + i, 1000 * b + i, rng.normal(size=5).tolist()) for b, (n, _) in sizes.items() for i in range(n)]
    d = [(b, 1000 * b + i, (10 * rng.normal(size=5)).tolist()) for b, (_, n) in sizes.items() for i in range(n)]
    q += [(0, 99, -5, [1.0] * 5), (7, 700, 7000, [1.0] * 5)]  # paired doc absent; batch without docs
    qdf, ddf = spark.createDataFrame(q, "b long, qid long, pos long, v array<double>"), spark.createDataFrame(d, "b long, docid long, v array<double>")
    args = dict(batch="b", qid="qid", pos="pos", docid="docid", vec="v", scale=3.0, metric=metric, block_rows=block_rows)
    got = {r["qid"]: r["loss"] for r in V.contrastive_loss(qdf, ddf, **args).collect()}
    want = {}
    for b, i, p, v in q:
        docs = [(k, np.array(x)) for c, k, x in d if c == b]
        unit = (lambda x: x / np.linalg.norm(x)) if metric == "cos_sim" else (lambda x: x)
        s = {k: 3.0 * unit(np.array(v)) @ unit(x) for k, x in docs}
        want[i] = np.logaddexp.reduce(list(s.values())) - s[p] if p in s else None
    assert set(got) == set(want)
    assert all(got[i] is None if w is None else abs(got[i] - w) < 1e-9 for i, w in want.items())
    for how, f in (("mean", np.mean), ("sum", np.sum)):
        per = {r["batch_id"]: r["loss"] for r in V.contrastive_loss(qdf, ddf, reduction=how, **args).collect()}
        assert abs(per[2] - f([want[i] for b, i, *_ in q if b == 2])) < 1e-9
    with pytest.raises(ValueError):
        V.contrastive_loss(qdf, ddf, reduction="max", **args)


def test_pooling_with_masks_of_any_shape(spark):
    rng = np.random.default_rng(8)
    masks = [[1, 1, 0, 1], [0, 1, 1, 1], [1, 1, 1, 1], [0, 0, 0, 0], [1, 0, 0, 0]]
    toks = rng.normal(size=(5, 4, 3))
    df = spark.createDataFrame([(i, t.tolist(), m) for i, (t, m) in enumerate(zip(toks, masks))], "id int, t array<array<double>>, m array<int>")
    for how in ("first_token", "last_token", "mean", "weightedmean"):
        got = {r["id"]: np.array(r["pooled"]) for r in V.pool_tokens(df, "t", None, how, mask="m").collect()}
        for i, (t, m) in enumerate(zip(toks, masks)):
            m = np.array(m, float)[:, None]
            h = t * m
            zero = np.flatnonzero(m[:, 0] == 0)
            last = max((zero[0] if len(zero) else 4) - 1, 0)
            w = m * np.arange(1, 5)[:, None]
            want = {"first_token": t[0], "last_token": h[last], "mean": h.sum(0) / max(m.sum(), 1e-9), "weightedmean": (h * w).sum(0) / max(w.sum(), 1e-9)}[how]
            assert np.allclose(got[i], want), (how, i)
