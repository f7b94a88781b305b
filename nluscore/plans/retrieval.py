"""Fixture queries for vector search and retrieval metrics over ``embeddings``.

Every vector is a query against the whole table (ignore_identical); relevance = same label.
Judgements are implicit (label counts), so no qrels pair table is ever materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cutoffs
from ..operators import evalset as E
from ..operators import retrieval as R
from ..operators import vectors as V
from .tables import load

TOP_K = 10


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings")


def _hits(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    e = _emb(spark, sf_dir)
    return V.top_k(e, e, k=k, qid="vec_id", docid="vec_id", vec="embedding", ignore_identical=True)


def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine top-10 of every vector, itself excluded."""
    h = _hits(spark, sf_dir)
    return h.select("qid", "docid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _labelled_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hits carry both labels out of the kernel (payloads), so relevance needs no join with the
    corpus; judged queries come from per-label counts (partial aggregate, broadcast when small)."""
    e = _emb(spark, sf_dir)
    h = V.top_k(e, e, k=TOP_K, qid="vec_id", docid="vec_id", vec="embedding", ignore_identical=True,
                qpayload="label", dpayload="label")
    hr = h.select("qid", "docid", "score", "rank", F.col("qpayload").cast("int").alias("source"),
                  (F.col("qpayload") == F.col("dpayload")).cast("int").alias("rel"))
    labels = e.select("vec_id", "label")
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    judged = (labels.join(counts, "label")
                    .select(F.col("vec_id").alias("qid"), F.col("label").alias("source"), (F.col("_n") - 1).alias("n_rel"))
                    .withColumn("ideal", R.binary_ideal(F.col("n_rel"), TOP_K)))
    return hr, judged


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRR, MAP, nDCG, recall, precision at 1, 3, 5, 10."""
    hr, judged = _labelled_hits(spark, sf_dir)
    return R.retrieval_metrics(hr, judged, cutoffs(TOP_K))


def retrieval_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search over the pooled queries, metrics per source (= query label)."""
    hr, judged = _labelled_hits(spark, sf_dir)
    return R.retrieval_metrics(hr, judged, cutoffs(TOP_K), by="source")


def bitext_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even vectors search the odd ones; correct when the rank-1 target has the same label."""
    e = _emb(spark, sf_dir)
    src = e.filter(F.col("vec_id") % 2 == 0)
    tgt = e.filter(F.col("vec_id") % 2 == 1)
    h = V.top_k(src, tgt, k=TOP_K, qid="vec_id", docid="vec_id", vec="embedding",
                qpayload="label", dpayload="label")
    hr = h.withColumn("rel", (F.col("qpayload") == F.col("dpayload")).cast("int"))
    tcount = tgt.groupBy("label").agg(F.count(F.lit(1)).alias("n_rel"))
    judged = src.join(tcount, "label").select(F.col("vec_id").alias("qid"), "n_rel")
    return R.bitext_metrics(hr, judged)


def _whole_numbers(e: DataFrame) -> DataFrame:
    """Vectors of eight whole numbers: their dot products are exact and tie often."""
    return e.withColumn("v", F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(x * 12).cast("double")))


def topk_string_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 (dot), V4, J6: external ids as text, ties in the order of trec evaluations."""
    e = _whole_numbers(_emb(spark, sf_dir)).select(F.concat(F.lit("E"), F.col("vec_id").cast("string")).alias("id"), "v")
    h = V.top_k(e, e, k=TOP_K, qid="id", docid="id", vec="v", metric="dot", ignore_identical=True, tie="string")
    return h.select("qid", "docid", "score", F.col("rank").cast("long").alias("rank"))


def qrels_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, V8-V12 on graded judgements: every vector's 40 successors are judged 3 (same label), 1 (next label) or 0; even vectors
    search, odd ones of every tenth pair are judged but never searched."""
    e = _whole_numbers(_emb(spark, sf_dir))
    queries = e.filter(F.col("vec_id") % 2 == 0)
    hits = V.top_k(queries, e, k=TOP_K, qid="vec_id", docid="vec_id", vec="v", metric="dot", ignore_identical=True)
    near = (e.filter((F.col("vec_id") % 2 == 0) | (F.col("vec_id") % 20 == 1))
             .select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 40)).alias("docid")))
    docs = e.select(F.col("vec_id").alias("docid"), F.col("label").alias("dl"))
    grade = F.when(F.col("ql") == F.col("dl"), 3).when(F.abs(F.col("ql") - F.col("dl")) == 1, 1).otherwise(0)
    qrels = near.join(docs, "docid").select("qid", "docid", grade.alias("rel"))
    return R.qrels_metrics(hits, qrels, cutoffs(TOP_K))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of three configs: an even vector asks for the text of the next odd one; texts recur within and across configs."""
    e = _emb(spark, sf_dir)
    q = e.filter(F.col("vec_id") % 2 == 0).select("vec_id", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("config"), F.col("embedding").alias("asked"))
    d = e.filter(F.col("vec_id") % 2 == 1).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("told"))
    return q.join(d, "vec_id").withColumn("text", F.concat(F.lit("entity "), F.pmod(F.expr("vec_id div 2") * 7, F.lit(101)).cast("string")))


def merged_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three configs, one corpus, one search, metrics merged and per config."""
    s = E.build_qrels(_pairs(spark, sf_dir), "text", "vec_id", "config", ["asked"], ["told"])
    return E.evaluate(s.queries, s.corpus, s.qrels, cutoffs(TOP_K), vec="told", qvec="asked")


def qrels_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and corpus of all languages' documents, a document judged relevant for the query of its row."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    s = E.build_qrels(docs, "text", "doc_id", "lang", ["doc_id"])
    size = s.corpus.select(F.col("docid").alias("shown"), F.length("text").cast("long").alias("doc_chars"))
    return (s.qrels.join(s.queries.select("qid", "doc_id"), "qid").join(size, F.col("docid") == F.col("shown"))
             .select("qid", "source", "doc_id", "docid", F.col("rel").cast("long").alias("rel"), "doc_chars"))


def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even vector = query, next odd vector = its positive doc, batches of 20 pairs."""
    e = _emb(spark, sf_dir)
    q = e.filter(F.col("vec_id") % 2 == 0).select(
        (F.col("vec_id") / 40).cast("long").alias("batch_id"), F.col("vec_id").alias("qid"),
        (F.col("vec_id") + 1).alias("pos_docid"), "embedding")
    d = e.filter(F.col("vec_id") % 2 == 1).select(
        (F.col("vec_id") / 40).cast("long").alias("batch_id"), F.col("vec_id").alias("docid"), "embedding")
    loss = V.contrastive_loss(q, d, batch="batch_id", qid="qid", pos="pos_docid", docid="docid",
                              vec="embedding", scale=20.0)
    return loss.select("batch_id", "qid", F.round("loss", 6).alias("loss"))


def contrastive_batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V15 reduced: mean and sum per batch of 200 pairs, scored in blocks of 64 rows (dot products)."""
    e = _emb(spark, sf_dir)
    batch = F.expr("vec_id div 400")
    q = e.filter(F.col("vec_id") % 2 == 0).select(batch.alias("batch_id"), F.col("vec_id").alias("qid"), (F.col("vec_id") + 1).alias("pos_docid"), "embedding")
    d = e.filter(F.col("vec_id") % 2 == 1).select(batch.alias("batch_id"), F.col("vec_id").alias("docid"), "embedding")
    out = [V.contrastive_loss(q, d, scale=5.0, metric="dot", reduction=r, block_rows=64).select("batch_id", F.lit(r).alias("reduction"), F.round("loss", 6).alias("loss"))
           for r in ("mean", "sum")]
    return out[0].unionByName(out[1])


def pool_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 with masks that have holes: each embedding cut into 8 tokens of 8 dims; token t counts unless (vec_id + 3 t) mod 5 is 0."""
    e = _emb(spark, sf_dir)
    toks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(F.col("embedding"), t * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: ((F.col("vec_id") + 3 * t) % 5 != 0).cast("int"))
    df = e.select("vec_id", toks.alias("tokens"), mask.alias("mask"))
    out = None
    for how in ("last_token", "mean", "weightedmean"):
        p = V.pool_tokens(df, "tokens", None, how, mask="mask").select("vec_id", F.lit(how).alias("method"), F.posexplode_outer("pooled").alias("dim", "value"))
        out = p if out is None else out.unionByName(p)
    return out.select("vec_id", "method", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def pool_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: each embedding cut into 8 tokens of 8 dims; the first label+1 tokens are attended."""
    e = _emb(spark, sf_dir)
    toks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(F.col("embedding"), t * 8 + 1, 8))
    df = e.select("vec_id", toks.alias("tokens"), (F.col("label") + 1).alias("mask_len"))
    outs = []
    for how in ("first_token", "last_token", "mean", "weightedmean"):
        p = V.pool_tokens(df, "tokens", "mask_len", how)
        outs.append(p.select("vec_id", F.lit(how).alias("method"),
                             F.posexplode_outer("pooled").alias("dim", "value")))
    u = outs[0]
    for o in outs[1:]:
        u = u.unionByName(o)
    return u.select("vec_id", "method", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))
