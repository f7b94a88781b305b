"""Retrieval metrics over ranked hits.

Hits are ``(qid, docid, rank)``; judgements are per query: ``n_rel`` (number of relevant docs) and
``ideal`` (relevance values sorted descending, at least max(k) long) for nDCG. Relevance of a hit
comes from a left join on ``(qid, docid)`` with the qrels (J8), or from any rule the caller
computes (e.g. equal labels), so qrels pairs are never needed when the rule is implicit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics_table import as_list, safe_ratio, to_long


def attach_relevance(hits: DataFrame, qrels: DataFrame, rel: str = "rel") -> DataFrame:
    """Hits ⟕ qrels on (qid, docid); missing judgement = 0; a pair judged twice has its greatest value."""
    q = qrels.groupBy("qid", "docid").agg(F.max(rel).alias("rel"))
    return hits.join(q, ["qid", "docid"], "left").withColumn("rel", F.coalesce(F.col("rel"), F.lit(0)))


def judged_from_qrels(qrels: DataFrame, max_k: int, by=None, rel: str = "rel", keep_empty: bool = False) -> DataFrame:
    """Per query ``n_rel`` and the ``ideal`` gains (top max_k relevance values, descending).

    ``keep_empty``: queries without a positive judgement stay, with n_rel 0 and no ideal gain.
    """
    by = as_list(by)
    q = qrels.groupBy("qid", *by, "docid").agg(F.max(rel).alias("_rel"))
    w = Window.partitionBy("qid", *by).orderBy(F.col("_rel").desc())
    top = q.filter(F.col("_rel") > 0).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_k)
    ideal = top.groupBy("qid", *by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_r"), F.col("_rel").cast("double").alias("_gain")))),
                                                lambda x: x["_gain"]).alias("ideal"))
    n = q.groupBy("qid", *by).agg(F.count_if(F.col("_rel") > 0).alias("n_rel"))
    keys = ["qid", *by]
    ideal = ideal.withColumnsRenamed({k: f"_ideal_{k}" for k in keys})
    same = [n[k].eqNullSafe(ideal[f"_ideal_{k}"]) for k in keys]
    j = n if keep_empty else n.filter(F.col("n_rel") > 0)
    j = j.join(ideal, same, "left").drop(*(f"_ideal_{k}" for k in keys))
    return j.withColumn("ideal", F.coalesce("ideal", F.array().cast("array<double>")))


def trec_ranks(hits: DataFrame) -> DataFrame:
    """Two places of every hit ``(qid, docid, score)`` among its query's: ``rank`` by score, then docid as text, both falling
    (the order of trec evaluations), and ``heap_rank`` by score, then docid itself (the order of the search)."""
    w = Window.partitionBy("qid")
    return (hits.withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), F.col("docid").cast("string").desc())))
                .withColumn("heap_rank", F.row_number().over(w.orderBy(F.col("score").desc(), F.col("docid").desc()))))


def qrels_metrics(hits: DataFrame, qrels: DataFrame, ks: Sequence[int], by=None) -> DataFrame:
    """V8-V12 of searched hits ``(qid, docid, score)`` against a qrels table ``(qid, docid, rel[, by...])``, graded or not.

    MAP, nDCG, recall and precision rank hits as trec evaluations do and average over judged queries with hits, those
    without a positive judgement counting 0; gains are the judged values, the ideal order takes all of a query's
    judgements. MRR takes the search's own order and divides by all judged queries, found or not.
    """
    judged = judged_from_qrels(qrels, max(ks), by, keep_empty=True)
    ranked = trec_ranks(attach_relevance(hits.select("qid", "docid", "score"), qrels))
    return retrieval_metrics(ranked, judged, ks, by, mrr_rank="heap_rank", keep_empty=True)


def binary_ideal(n_rel: Column, max_k: int) -> Column:
    """Ideal gains for binary relevance: min(n_rel, max_k) ones."""
    return F.array_repeat(F.lit(1.0), F.least(n_rel, F.lit(max_k)).cast("int"))


def _idcg(ideal: Column, k: int) -> Column:
    top = F.slice(ideal, 1, k)
    return F.aggregate(F.transform(top, lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)


def per_query_metrics(hits: DataFrame, judged: DataFrame, ks: Sequence[int], by=None, mrr_rank: str = "rank",
                      keep_empty: bool = False) -> DataFrame:
    """MRR, AP, nDCG, recall, precision at each cut-off, one row per judged query with hits.

    ``mrr_rank``: the column that orders hits for MRR; ``keep_empty``: queries without a relevant doc count 0."""
    by = as_list(by)
    relevant = (F.col("rel") > 0).cast("double")
    w = Window.partitionBy("qid").orderBy("rank")
    h = hits.withColumn("_cum", F.sum(relevant).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [
            F.min(F.when((F.col(mrr_rank) <= k) & (F.col("rel") > 0), F.col(mrr_rank))).alias(f"_first_{k}"),
            F.sum(F.when(inside & (F.col("rel") > 0), F.col("_cum") / F.col("rank")).otherwise(0.0)).alias(f"_ap_{k}"),
            F.sum(F.when(inside, F.col("rel").cast("double") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"_dcg_{k}"),
            F.sum(F.when(inside, relevant).otherwise(0.0)).alias(f"_hit_{k}"),
        ]
    pq = h.groupBy("qid").agg(*aggs)
    j = pq.join(judged if keep_empty else judged.filter(F.col("n_rel") > 0), "qid", "inner")
    cols = [*by, "qid"]
    for k in ks:
        cols += [
            F.coalesce(1.0 / F.col(f"_first_{k}"), F.lit(0.0)).alias(f"mrr_at_{k}"),
            safe_ratio(F.col(f"_ap_{k}"), F.col("n_rel")).alias(f"map_at_{k}"),
            safe_ratio(F.col(f"_dcg_{k}"), _idcg(F.col("ideal"), k)).alias(f"ndcg_at_{k}"),
            safe_ratio(F.col(f"_hit_{k}"), F.col("n_rel")).alias(f"recall_at_{k}"),
            (F.col(f"_hit_{k}") / float(k)).alias(f"precision_at_{k}"),
        ]
    return j.select(*cols)


def retrieval_metrics(hits: DataFrame, judged: DataFrame, ks: Sequence[int], by=None, mrr_rank: str = "rank",
                      keep_empty: bool = False) -> DataFrame:
    """V8-V12 averaged per ``by`` key → long ``(by..., metric, value)``.

    MRR divides by the number of judged queries (queries without hits count 0); the other
    metrics average over judged queries that have hits. Per-query rows and judged queries are
    unioned and reduced by one grouped aggregate (no join of aggregates).
    """
    by = as_list(by)
    pq = per_query_metrics(hits, judged, ks, by, mrr_rank, keep_empty)
    names = [f"{m}_at_{k}" for k in ks for m in ("mrr", "map", "ndcg", "recall", "precision")]
    jq = (judged if keep_empty else judged.filter(F.col("n_rel") > 0)).select(*by, F.lit(1).alias("_judged"))
    u = pq.drop("qid").withColumn("_judged", F.lit(0)).unionByName(jq, allowMissingColumns=True)
    nq = F.sum("_judged")
    aggs = [(F.sum(n) / nq).alias(n) if n.startswith("mrr") else F.avg(n).alias(n) for n in names]
    wide = u.groupBy(*by).agg(*aggs)
    return to_long(wide, by, names)


def bitext_metrics(hits: DataFrame, judged: DataFrame, by=None) -> DataFrame:
    """From the rank-1 hit: accuracy = recall = sum(rel)/|judged|,
    precision = sum(rel)/|distinct rank-1 docs|, F1 (0 when both are 0)."""
    by = as_list(by)
    top1 = hits.filter(F.col("rank") == 1).select(*by, F.col("rel").cast("double").alias("_rel"), "docid",
                                                  F.lit(0).alias("_judged"))
    jq = judged.filter(F.col("n_rel") > 0).select(*by, F.lit(1).alias("_judged"))
    u = top1.unionByName(jq, allowMissingColumns=True)
    a = u.groupBy(*by).agg(F.sum("_rel").alias("_correct"), F.countDistinct("docid").alias("_docs"),
                           F.sum("_judged").alias("_nq"))
    rec = safe_ratio(F.col("_correct"), F.col("_nq"))
    prec = safe_ratio(F.col("_correct"), F.col("_docs"))
    wide = a.select(*by, rec.alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
                    safe_ratio(2 * prec * rec, prec + rec).alias("f1"))
    return to_long(wide, by)
