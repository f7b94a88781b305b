"""Streaming top-k restarts and property tests (results do not depend on partitioning)."""

import os

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nluscore.operators import classify as C
from nluscore.operators import vectors as V
from nluscore.streaming import topk_stream as S


def test_stream_restart_and_incremental(spark, tmp_dir):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(60, 6))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "docid long, embedding array<double>")
    q = df.withColumnRenamed("docid", "qid").filter("qid % 4 = 0")
    src, state, ck = (os.path.join(tmp_dir, x) for x in ("src", "state", "ck"))
    df.filter("docid < 30").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        S.top_k_stream(q, stream, 5, state, ck).awaitTermination()
        return sorted(tuple(r) for r in S.read_state(spark, state, 5).collect())

    first = run()
    assert run() == first                       # restart: nothing new, same state
    df.filter("docid >= 30").write.mode("append").parquet(src)
    final = run()
    batch = V.top_k(q, df, 5)
    assert final == sorted(tuple(r) for r in batch.collect())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.sampled_from(["a", "b"])), min_size=3, max_size=60),
       st.integers(1, 9))
def test_class_metrics_partition_invariant(spark, rows, parts):
    df = spark.createDataFrame(rows, "pred int, gold int, k string")
    a = sorted(tuple(r) for r in C.class_metrics(df, "pred", "gold", "k").collect())
    b = sorted(tuple(r) for r in C.class_metrics(df.repartition(parts), "pred", "gold", "k").collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[0] == y[0] and np.allclose(x[1:], y[1:], equal_nan=True)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(-5, 5, allow_nan=False), min_size=4, max_size=50), st.integers(1, 7))
def test_spearman_partition_invariant(spark, xs, parts):
    rows = [(float(x), float((i * 7) % 11)) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "x double, y double")
    a = C.spearman(df, "x", "y").first()[0]
    b = C.spearman(df.repartition(parts), "x", "y").first()[0]
    assert (np.isnan(a) and np.isnan(b)) or abs(a - b) < 1e-12
