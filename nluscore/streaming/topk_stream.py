"""Incremental exact top-k while the corpus arrives as a stream.

Structured Streaming delivers corpus micro-batches; ``foreachBatch`` scores each batch with the
block scorer (V4) and merges it with the state of the previous batch (V5, (qid, docid) de-duplicated). The
state lives in two slots that take turns: batch b reads slot (b - 1) % 2 and overwrites slot b % 2, so a
replayed micro-batch rewrites the same slot from the same input (idempotent), and no older version
stays behind; the stream checkpoint records progress. State is k rows per query, never the corpus.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import merge_top_k, top_k, vector_blocks
from ..session import scratch_path


def _slot(spark: SparkSession, state: str, number: int) -> DataFrame | None:
    """The rows of a slot; None when it was never written."""
    try:
        return spark.read.parquet(f"{state}/slot={number}")
    except AnalysisException:
        return None


def top_k_stream(queries: DataFrame, corpus_stream: DataFrame, k: int, state: str, checkpoint: str,
                 qid: str = "qid", docid: str = "docid", vec: str = "embedding", metric: str = "cos_sim",
                 ignore_identical: bool = False, tie: str = "id", trigger_available_now: bool = True):
    """Start (and, with ``availableNow``, finish) the stream; returns the StreamingQuery."""
    spark = queries.sparkSession
    blocks = vector_blocks(queries, vec)   # counted once for all batches

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        parts = [top_k(queries, batch, k, qid, docid, vec, metric=metric, ignore_identical=ignore_identical,
                       tie=tie, query_blocks=blocks)]
        prev = _slot(spark, state, (batch_id - 1) % 2) if batch_id else None
        if prev is not None:
            parts.append(prev.filter(F.col("version") == batch_id - 1))
        merged = merge_top_k(parts, k, tie).select("qid", "docid", "score", F.lit(batch_id).cast("long").alias("version"))
        merged.write.mode("overwrite").parquet(f"{state}/slot={batch_id % 2}")

    w = corpus_stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_state(spark: SparkSession, state: str, k: int, tie: str = "id") -> DataFrame:
    """Final hits ``(qid, docid, score, rank)`` of the newest version; empty before the first batch."""
    slots = [s for s in (_slot(spark, state, 0), _slot(spark, state, 1)) if s is not None]
    if not slots:
        return spark.createDataFrame([], "qid long, docid long, score double, rank int")
    rows = slots[0] if len(slots) == 1 else slots[0].unionByName(slots[1])
    newest = rows.agg(F.max("version")).first()[0]
    return merge_top_k([rows.filter(F.col("version") == F.lit(newest))], k, tie)


def stage_batches(df: DataFrame, n_batches: int, order: str, path: str) -> str:
    """Write ``df`` as ``n_batches`` files (range split on ``order``) for a file-source stream."""
    df.repartitionByRange(n_batches, order).write.mode("overwrite").parquet(path)
    return path


def run_top_k_stream(queries: DataFrame, corpus: DataFrame, k: int, n_batches: int = 5, **kw) -> DataFrame:
    """Stage the corpus into ``n_batches`` files, stream them one per trigger, return the final hits."""
    spark = queries.sparkSession
    base = scratch_path(spark, "topk-stream")
    src = stage_batches(corpus, n_batches, kw.get("docid", "docid"), f"{base}/source")
    stream = (spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1)
              .parquet(src))
    q = top_k_stream(queries, stream, k, f"{base}/state", f"{base}/checkpoint", **kw)
    q.awaitTermination()
    return read_state(spark, f"{base}/state", k)
