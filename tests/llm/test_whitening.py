"""Whitening: Jacobi-Davidson against numpy's eigenvectors, the query against brute force, odd rows."""

import numpy as np
import pytest

from nluscore.llm import whitening
from nluscore.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("d,k,spread", [(64, 16, 1.0), (64, 16, 0.02), (40, 16, 3.0), (16, 16, 1.0), (5, 16, 1.0), (1, 16, 1.0), (300, 16, 0.5), (48, 3, 1.0)])
def test_leading_pairs_equal_eigh(d, k, spread):
    rng = np.random.default_rng(d + k)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = np.sort(30 * np.exp(spread * rng.normal(size=d)))[::-1]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    theta, u, figures = whitening.leading_pairs(lambda x: a @ x, d, k)
    k = min(k, d)
    assert len(theta) == k and figures["residual"] < 1e-13
    assert np.allclose(theta, e[:k], rtol=1e-13, atol=0)
    gaps = np.abs(np.subtract.outer(e, e)) + np.diag(np.full(d, np.inf))
    for i in range(k):
        if gaps[i].min() > 1e-4 * e[0]:
            assert abs(u[:, i] @ q[:, i]) > 1 - 1e-9
    assert np.allclose(u.T @ u, np.eye(k), atol=1e-13)


def test_repeated_and_zero_eigenvalues():
    d = 30
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(d, d)))[0]
    for e in (np.r_[[5.0] * 20, [1.0] * 10], np.r_[[3.0, 2.0], [0.0] * 28], np.r_[[7.0] * 30]):
        a = (q * e) @ q.T
        theta, u, _ = whitening.leading_pairs(lambda x: a @ x, d, 16)
        assert np.allclose(theta, e[:16], atol=1e-12) and np.allclose(a @ u, u * theta, atol=1e-12)


def brute(rows):
    """{(id, component): (n, deviation, whitened, explained)} by exact integers and a full eigendecomposition."""
    x = [(i, [int(np.floor(64 * np.float64(c))) + 1000000 for c in v]) for i, v in rows
         if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({tuple(v) for _, v in x})
    n, sums = len(distinct), [sum(col) for col in zip(*distinct)]
    c = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in distinct])
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, v in x:
        far = [n * a - s for a, s in zip(v, sums)]
        for k in range(min(16, len(e))):
            out[i, k + 1] = (n, sum(a * a for a in far), np.array(far) / n @ u[:, k] / np.sqrt(e[k]), e[k] / np.trace(cov))
    return out


def same(got, want):
    assert len(got) == len(want)
    sign = {}
    for r in got:
        n, dev, z, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev)
        if abs(z) > 0.1:
            sign.setdefault(r.component, np.sign(z * r.whitened))
        s = sign.get(r.component, 1)
        assert abs(r.whitened - s * z) < 1e-6 * max(1, abs(z)) or abs(z) <= 0.1
        assert abs(r.explained - share) < 1e-10 * share and 0 <= r.identity_error < 1e-9


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    same(QUERIES["op13_embedding_whitening"](spark, SF).collect(), brute([(r.vec_id, r.embedding) for r in rows]))


def test_odd_rows_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(60)]
    rows += [(k + 100, rows[3][1]) for k in range(300)]  # one vector holds most rows
    odd = [(900, None), (901, []), (902, [None] + [0.0] * 5), (903, [float("nan")] * 6), (904, [float("inf")] + [1.0] * 5), (905, [1.0, 2.0])]
    d = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows + odd], "vec_id bigint, embedding array<double>, x string, n int")
    same(whitening.whiten(d).collect(), brute(rows))
    again = spark.createDataFrame([(None, v) for _, v in rows[:60]], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(again).count() == 60 * 6
    assert whitening.whiten(d.limit(0)).count() == 0
    assert whitening.whiten(d.where("vec_id = 1")).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 1.0, float(k)]) for k in range(20)], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(flat).collect()
    assert len(got) == 20 and {r.component for r in got} == {1}


def test_exact_squares_beyond_63_bits():
    x = np.array([[1000000, 1000001], [1 << 40, 5]])
    assert whitening.squares(x, 3, np.array([1, 2])) == [(3 * 1000000 - 1) ** 2 + (3 * 1000001 - 2) ** 2, None]
