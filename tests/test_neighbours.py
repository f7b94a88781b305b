"""Neighbour rows across range partitions against a plain walk over each key."""

import random

import pytest
from pyspark.sql import functions as F

from nluscore.operators import prefix as W


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_neighbours_equal_a_walk(spark, parts):
    rng = random.Random(parts)
    rows = [("hot", None, i, f"h{i}", i % 9 == 0) for i in range(300)]
    rows += [(f"k{j}" if j else None, j % 2, i, f"{j}.{i}" if rng.random() < 0.9 else None, rng.random() < 0.4) for j in range(30) for i in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "g string, h int, t int, v string, ok boolean").repartition(5)
    got = W.neighbour_values(df, ["t"], {"before": ("v", -1, None), "after": ("v", 1, None), "last_ok": ("t", -1, F.col("ok")), "next_ok": ("v", 1, F.col("ok"))},
                             by=["g", "h"], parts=parts)
    assert got.columns == [*df.columns, "before", "after", "last_ok", "next_ok"]
    by_key = {}
    for r in rows:
        by_key.setdefault(r[:2], []).append(r)
    want = []
    for key, some in by_key.items():
        some.sort(key=lambda r: r[2])
        for i, r in enumerate(some):
            ok_before, ok_after = [x for x in some[:i] if x[4]], [x for x in some[i + 1:] if x[4]]
            want.append((*r, some[i - 1][3] if i else None, some[i + 1][3] if i + 1 < len(some) else None,
                         ok_before[-1][2] if ok_before else None, ok_after[0][3] if ok_after else None))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_neighbours_without_a_key_and_of_empty_tables(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "t int")
    got = sorted(map(tuple, W.neighbour_values(df, ["t"], {"p": ("t", -1, None)}, parts=4).collect()))
    assert got == [(i, i - 1 if i else None) for i in range(10)]
    assert W.neighbour_values(df.limit(0), ["t"], {"p": ("t", -1, None)}, parts=4).count() == 0
