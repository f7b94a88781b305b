"""Keyed permutations and draws without replacement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nluscore.functions import permute as P
from nluscore.operators import tuples as X


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 63, 64, 65, 1000, 4097])
def test_every_key_names_a_permutation(n):
    seen = set()
    for key in (0, 1, 77, (1 << 31) - 1):
        got = P.permute(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(got.tolist()) == list(range(n))
        seen.add(tuple(got.tolist()))
    assert len(seen) > 2 or n < 16


def test_places_are_spread():
    n = 1000
    first = np.array([P.permute(np.array([0]), np.array([n]), np.array([k * 2654435 % (1 << 31)]))[0] for k in range(4000)])
    counts = np.bincount(first // 100, minlength=10)
    assert counts.min() > 300 and counts.max() < 500


def test_column_form_and_odd_arguments(spark):
    rows = [(0, 5, 1), (4, 5, 1), (5, 5, 1), (-1, 5, 1), (None, 5, 1), (1, None, 1), (0, 0, 1), (3, 1 << 40, 9)]
    df = spark.createDataFrame(rows, "i long, n long, k long")
    got = [r[0] for r in df.select(P.permuted(F.col("i"), F.col("n"), F.col("k"))).collect()]
    assert [g is None for g in got] == [False, False, True, True, True, True, True, False]
    assert got[0] != got[1] and 0 <= got[7] < 1 << 40


def test_borrowing_gives_k_whenever_k_exist(spark):
    # groups of one: no positives; only even items have negatives, so only they can lend
    rows = [(i, i) for i in range(40)]
    members = X.index_members(spark.createDataFrame(rows, "vec_id long, label long"), "label", "vec_id", "vec_id")
    inst = members.select(F.col("_item").alias("q"), F.col("label").alias("pg"), F.col("idx").alias("si"),
                          F.when(F.col("_item") % 2 == 0, F.pmod(F.col("_item") + 1, F.lit(40))).otherwise(-1).alias("ng"))
    for k in (2, 7, 19, 25):
        by_q = {}
        for r in X.borrow_negatives(inst, members, "q", "pg", "ng", "si", k, 1, 42).collect():
            by_q.setdefault(r["q"], {})[r["position"]] = r["negative"]
        assert len(by_q) == 40
        for q, got in by_q.items():
            own = 1 - q % 2
            most = min(k, own + 20 - own)  # twenty lenders, oneself not among them
            assert sorted(got) == list(range(1, most + 1)), (k, q)
            assert not own or got[1] == (q + 1) % 40
            borrowed = [v for p, v in got.items() if p > own]
            assert len(set(borrowed)) == len(borrowed) and all(v % 2 for v in borrowed)


def test_shuffled_negatives_never_repeat_within_a_round(spark):
    members = X.index_members(spark.createDataFrame([(i, 0) for i in range(10)], "vec_id long, label long"), "label", "vec_id", "vec_id")
    inst = members.select(F.col("_item").alias("q"), F.lit(0).alias("ng"))
    seen = {}
    for epoch in (0, 1):
        for r in X.pick_negatives(inst, members, "q", "ng", 5, epoch, 7, shuffle=True).collect():
            seen.setdefault(r["q"], []).append(r["negative"])
    assert all(sorted(v) == list(range(10)) for v in seen.values()) and len({tuple(v) for v in seen.values()}) > 3
