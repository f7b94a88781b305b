"""Evaluation sets for retrieval: queries, corpus and qrels from pairs of texts or from external ids.

Several configs share one search: query ids number the queries of all configs, corpus ids number the distinct
positive texts of all of them, and qrels point from the one to the other, so a text that two configs
share is one document. Metrics are then taken over all queries and per config.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .labels import dedupe_corpus, text_key
from .metrics_table import as_list
from .prefix import with_row_id
from .retrieval import qrels_metrics
from .vectors import top_k


class EvalSet(NamedTuple):
    queries: DataFrame  # qid, source, and the carried query columns
    corpus: DataFrame   # docid, and the carried document columns
    qrels: DataFrame    # qid, docid, rel, source


def build_qrels(pairs: DataFrame, positive: str, order: Sequence[str] | str, source: str | None = None,
                query_columns: Sequence[str] = (), doc_columns: Sequence[str] = (), key=text_key) -> EvalSet:
    """One query per row of ``pairs``, one document per distinct ``positive`` text, one judgement per row.

    ``order`` makes rows unique (with ``source`` before it): query ids follow it, and documents are numbered as first seen
    in it. ``query_columns`` go with the queries; ``doc_columns`` are those of the row that shows a document first.
    Texts are told apart by hash keys that are verified; a null text is a document of its own.
    """
    order = as_list(order)
    src = F.col(source).cast("string") if source else F.lit(None).cast("string")
    carried = list(dict.fromkeys([positive, *query_columns, *doc_columns]))
    rows = pairs.select(src.alias("source"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), *(F.col(c).alias(f"_c_{c}") for c in carried))
    # rows are written once, with their number: all that follows reads them from there
    rows = cut_lineage(with_row_id(rows, ["source", *(f"_o{k}" for k in range(len(order)))], "qid")
                       .select("qid", "source", *(F.col(f"_c_{c}").alias(c) for c in carried)))
    named = cut_lineage(dedupe_corpus(rows, positive, "qid", "docid", key))
    told = rows.join(named, "qid")
    return EvalSet(told.select("qid", "source", *query_columns), told.filter("is_first").select("docid", *dict.fromkeys([positive, *doc_columns])),
                   told.select("qid", "docid", F.lit(1).alias("rel"), "source"))


def external_qrels(queries: DataFrame, positive_id: str, order: Sequence[str] | str, source: str | None = None,
                   query_columns: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """I3 with a corpus of its own: (queries, qrels), the judged document being the id in ``positive_id``, of any type.
    Rows without one are queries without a judgement."""
    order = as_list(order)
    src = F.col(source).cast("string") if source else F.lit(None).cast("string")
    rows = queries.select(src.alias("source"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.col(positive_id).alias("docid"), *query_columns)
    rows = with_row_id(rows, ["source", *(f"_o{k}" for k in range(len(order)))], "qid")
    return (rows.select("qid", "source", *query_columns),
            rows.filter(F.col("docid").isNotNull()).select("qid", "docid", F.lit(1).alias("rel"), "source"))


def evaluate(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, ks: Sequence[int], vec: str = "embedding",
             qvec: str | None = None, metric: str = "cos_sim", ignore_identical: bool = False, merged: str = "merged") -> DataFrame:
    """One search of all queries over one corpus, metrics over all of them (source ``merged``) and per source."""
    hits = cut_lineage(top_k(queries, corpus, max(ks), "qid", "docid", vec, qvec, metric, ignore_identical))
    both = qrels_metrics(hits, qrels, ks).withColumn("source", F.lit(merged)).unionByName(qrels_metrics(hits, qrels, ks, by="source"))
    return both.select("source", "metric", "value")
