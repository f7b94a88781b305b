"""Fixture queries for QA answer scoring.

Predictions are assistant turns; golds are the preceding user turn and the next assistant turn
of the same conversation (SQuAD v1 style). SQuAD v2 uses documents ⋈ labels: answerable, with the whole text as its
answer, when quality = 1; the prediction abstains ('') when toxic = 1, else is the whole text, changed in two of
three documents; na_prob = (n_chars % 100) / 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import qa as Q
from ..operators import tokens as T
from ..operators.prefix import neighbour_values
from .tables import load

IDS = ["conv_id", "turn"]


def _turn_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Per assistant turn: prediction = its text; golds = the preceding turn if it is a user turn,
    and the next assistant turn of the conversation.

    Neighbouring turns come from one range partition on (conv_id, turn) (W2), so one huge conversation is
    spread over many tasks and texts are shuffled once.
    """
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv = conv.withColumn("said", F.struct("role", "text"))
    x = neighbour_values(conv, ["turn"], {"prev": ("said", -1, None), "next_asst": ("text", 1, F.col("role") == "assistant")}, by="conv_id")
    x = x.filter(F.col("role") == "assistant")
    golds = F.filter(F.array(F.when(F.col("prev.role") == "user", F.col("prev.text")), F.col("next_asst")), lambda g: g.isNotNull())
    refs = x.select(*IDS, golds.alias("answers")).filter(F.size("answers") > 0)
    preds = x.select(*IDS, F.col("text").alias("prediction_text"))
    return preds, refs


def answer_em_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per id exact match and token F1 (max over golds)."""
    preds, refs = _turn_pairs(spark, sf_dir)
    s = Q.score_answers(preds, refs, IDS, version=1)
    return s.select(*IDS, F.round("exact", 6).alias("exact_match"), F.round("f1", 6).alias("f1"))


def squad_v1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_match and f1 (x100) over all references."""
    preds, refs = _turn_pairs(spark, sf_dir)
    return Q.squad_v1(preds, refs, IDS)


def _v2_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    b = labels.join(docs, "doc_id")
    golds = F.when(F.col("quality") == 1, F.array("text")).otherwise(F.array().cast("array<string>"))
    pred = F.when(F.col("toxic") == 1, F.lit("")).when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.expr("replace(text, 'er', 'e ')"))
    base = b.select("doc_id", golds.alias("answers"), pred.alias("prediction_text"),
                    ((F.col("n_chars") % 100) / 100.0).alias("na_prob"))
    refs = base.select("doc_id", "answers", "na_prob", Q.has_answer("answers").alias("has_ans"))
    preds = base.select("doc_id", "prediction_text")
    s = Q.score_answers(preds, refs, ["doc_id"], version=2, keep=["na_prob", "has_ans"])
    return s.withColumnRenamed("prediction_text", "pred")


def squad_v2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12-Q15: exact, f1, total and the HasAns_/NoAns_ slices; above a probability of 0.8 "no answer" is the answer."""
    return Q.squad_v2_summary(_v2_raw(spark, sf_dir), thresh=0.8)


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16: best no-answer thresholds for exact and f1 (running sum over na_prob order, W7)."""
    return Q.best_threshold(_v2_raw(spark, sf_dir), ["doc_id"])


SPAN_WINDOW, SPAN_OVERLAP = 62, 16


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document as a context, its whole text in windows of 62 tokens that share 16; [CLS] and [SEP] have no offsets. The
    logits of window w of document d are vector (d + 7 w) mod n, those of the end reversed: 64 places, more than a
    last window's tokens need."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), F.col("text").alias("context"))
    # only the windows' numbers go to the vectors, and the vectors to the text: the windows of an example stay together
    sizes = T.tokenize_offsets(docs, "context").groupBy("example_id").agg(F.max("n_tokens").alias("n_tokens"))
    asked = T.window_tokens(sizes, "n_tokens", SPAN_WINDOW, SPAN_OVERLAP).select(
        "example_id", "window_id", F.pmod(F.col("example_id") + 7 * F.col("window_id"), F.lit(e.count())).alias("vec_id"))
    logits = asked.join(e, "vec_id").groupBy("example_id").agg(F.collect_list(F.struct("window_id", "embedding")).alias("logits"))
    x = T.tokenize_offsets(docs.join(logits, "example_id"), "context")
    w = T.window_tokens(x.drop("context"), "n_tokens", SPAN_WINDOW, SPAN_OVERLAP, given="logits")
    feats = w.select("example_id", F.col("window_id").alias("feature"), F.col("embedding").alias("start_logits"),
                     F.reverse("embedding").alias("end_logits"), T.window_offsets().alias("offsets"))
    return feats, docs


def nbest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q6: n-best (20) answer spans per example with the null answer, texts and probabilities."""
    feats, docs = _features(spark, sf_dir)
    nb = Q.nbest(Q.span_candidates(feats, 20, 30), docs, 20, with_null=True)
    return nb.select("example_id", F.col("rank").cast("long").alias("rank"), "text",
                     F.round(F.col("score").cast("double"), 6).alias("score"),
                     F.round("probability", 6).alias("probability"))


def qa_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: v2 answer per example (null threshold 0.0) and its null odds."""
    feats, docs = _features(spark, sf_dir)
    nb = Q.nbest(Q.span_candidates(feats, 20, 30), docs, 20, with_null=True)
    p = Q.pick_answer(nb, v2=True, null_score_diff_threshold=0.0)
    return p.select("example_id", "prediction_text", F.round("score_diff", 6).alias("score_diff"))


def qa_predictions_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2 (maximum context), Q5, Q7: v1 answer per example, from places that are no multiple of four plus one."""
    feats, docs = _features(spark, sf_dir)
    feats = feats.withColumn("widest", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: p % 4 != 1))
    nb = Q.nbest(Q.span_candidates(feats, 20, 30, max_context="widest"), docs, 20, with_null=False)
    return Q.pick_answer(nb, v2=False)
