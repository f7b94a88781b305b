"""Fixture query for the streaming top-k: the embeddings arrive in 5 micro-batches; the final
state must equal the batch ``topk_cosine`` result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.topk_stream import run_top_k_stream
from .retrieval import TOP_K
from .tables import load


def topk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V16 (+ V5): incremental top-10 over 5 corpus micro-batches."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    h = run_top_k_stream(e, e, TOP_K, n_batches=5, qid="vec_id", docid="vec_id", vec="embedding",
                         ignore_identical=True)
    return h.select("qid", "docid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
