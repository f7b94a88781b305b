"""Index of fixture queries and their oracle SQL (wired into ``__spark_entry__``)."""

from __future__ import annotations

from . import classification as cls
from . import oracle_sql as sql
from . import io as sinkio
from . import labels as lab
from . import qa
from . import report as rep
from . import retrieval as ret
from . import streaming as stream
from . import tokens as tok
from . import tuples as tup

QUERIES = {
    "accuracy_by_lang": cls.accuracy_by_lang,
    "f1_mcc_by_lang": cls.f1_mcc_by_lang,
    "pearson_spearman": cls.pearson_spearman,
    "weighted_mse": cls.weighted_mse,
    "topk_cosine": ret.topk_cosine,
    "retrieval_metrics": ret.retrieval_metrics,
    "retrieval_by_source": ret.retrieval_by_source,
    "bitext_metrics": ret.bitext_metrics,
    "topk_string_ids": ret.topk_string_ids,
    "qrels_metrics": ret.qrels_metrics,
    "merged_eval": ret.merged_eval,
    "qrels_build": ret.qrels_build,
    "contrastive_loss": ret.contrastive_loss,
    "contrastive_batch_loss": ret.contrastive_batch_loss,
    "pool_masked": ret.pool_masked,
    "custom_metric_states": cls.custom_metric_states,
    "pool_tokens": ret.pool_tokens,
    "answer_em_f1": qa.answer_em_f1,
    "squad_v1_summary": qa.squad_v1_summary,
    "squad_v2_summary": qa.squad_v2_summary,
    "best_threshold": qa.best_threshold,
    "nbest_answers": qa.nbest_answers,
    "qa_predictions": qa.qa_predictions,
    "qa_predictions_v1": qa.qa_predictions_v1,
    "label_vocab": lab.label_vocab,
    "unseen_labels": lab.unseen_labels,
    "multilabel_f1": lab.multilabel_f1,
    "corpus_dedupe": lab.corpus_dedupe,
    "choice_accuracy": lab.choice_accuracy,
    "doc_windows": tok.doc_windows,
    "span_labels": tok.span_labels,
    "align_tags": tok.align_tags,
    "entity_report": tok.entity_report,
    "entity_report_by_lang": tok.entity_report_by_lang,
    "pair_truncation": tok.pair_truncation,
    "training_tuples": tup.training_tuples,
    "borrowed_negatives": tup.borrowed_negatives,
    "shuffled_negatives": tup.shuffled_negatives,
    "suite_report": rep.suite_report,
    "glue_report": rep.glue_report,
    "multilingual_report": rep.multilingual_report,
    "topk_stream": stream.topk_stream,
    "predictions_roundtrip": sinkio.predictions_roundtrip,
    "tags_roundtrip": sinkio.tags_roundtrip,
    "results_roundtrip": sinkio.results_roundtrip,
}

ORACLE = {
    "accuracy_by_lang": sql.ACCURACY_BY_LANG,
    "f1_mcc_by_lang": sql.F1_MCC_BY_LANG,
    "pearson_spearman": sql.PEARSON_SPEARMAN,
    "weighted_mse": sql.WEIGHTED_MSE,
    "topk_cosine": sql.TOPK_COSINE,
    "retrieval_metrics": sql.RETRIEVAL_METRICS,
    "retrieval_by_source": sql.RETRIEVAL_BY_SOURCE,
    "bitext_metrics": sql.BITEXT_METRICS,
    "topk_string_ids": sql.TOPK_STRING_IDS,
    "qrels_metrics": sql.QRELS_METRICS,
    "merged_eval": sql.MERGED_EVAL,
    "qrels_build": sql.QRELS_BUILD,
    "contrastive_loss": sql.CONTRASTIVE_LOSS,
    "contrastive_batch_loss": sql.CONTRASTIVE_BATCH_LOSS,
    "pool_masked": sql.POOL_MASKED,
    "custom_metric_states": sql.CUSTOM_METRIC_STATES,
    "pool_tokens": sql.POOL_TOKENS,
    "answer_em_f1": sql.ANSWER_EM_F1,
    "squad_v1_summary": sql.SQUAD_V1_SUMMARY,
    "squad_v2_summary": sql.SQUAD_V2_SUMMARY,
    "best_threshold": sql.BEST_THRESHOLD,
    "nbest_answers": sql.NBEST_ANSWERS,
    "qa_predictions": sql.QA_PREDICTIONS,
    "qa_predictions_v1": sql.QA_PREDICTIONS_V1,
    "label_vocab": sql.LABEL_VOCAB,
    "unseen_labels": sql.UNSEEN_LABELS,
    "multilabel_f1": sql.MULTILABEL_F1,
    "corpus_dedupe": sql.CORPUS_DEDUPE,
    "choice_accuracy": sql.CHOICE_ACCURACY,
    "doc_windows": sql.DOC_WINDOWS,
    "span_labels": sql.SPAN_LABELS,
    "align_tags": sql.ALIGN_TAGS,
    "entity_report": sql.ENTITY_REPORT,
    "entity_report_by_lang": sql.ENTITY_REPORT_BY_LANG,
    "pair_truncation": sql.PAIR_TRUNCATION,
    "training_tuples": sql.TRAINING_TUPLES,
    "borrowed_negatives": sql.BORROWED_NEGATIVES,
    "shuffled_negatives": sql.SHUFFLED_NEGATIVES,
    "suite_report": sql.SUITE_REPORT,
    "glue_report": sql.GLUE_REPORT,
    "multilingual_report": sql.MULTILINGUAL_REPORT,
    "topk_stream": sql.TOPK_COSINE,
    "predictions_roundtrip": sql.PREDICTIONS_ROUNDTRIP,
    "tags_roundtrip": sql.TAGS_ROUNDTRIP,
    "results_roundtrip": sql.RESULTS_ROUNDTRIP,
}
