"""Fixture queries for vocabularies, multi-label metrics, corpus de-duplication, multiple choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import choice as CH
from ..operators import classify as C
from ..operators import labels as L
from ..operators.metrics_table import to_long
from ..operators.prefix import with_row_id
from .tables import load

def split_col():
    """event_id % 10: 0-7 train, 8 validation, 9 test (every row belongs to one split)."""
    return (F.when(F.col("event_id") % 10 < 8, "train").when(F.col("event_id") % 10 == 8, "validation")
             .otherwise("test"))


def label_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L3, L4: vocabulary of event_type over all splits, then rows per (split, label id)."""
    ev = load(spark, sf_dir, "events").select("event_id", "event_type").withColumn("split", split_col())
    vocab = L.label_list(ev, "event_type")
    enc = L.encode_label(ev, vocab, "event_type")
    return (enc.groupBy("split", F.col("event_type").alias("label"), "label_id")
               .agg(F.count(F.lit(1)).alias("n")))


def unseen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 report: labels ``user_id:k`` (k from the JSON props) of validation/test that train never has."""
    ev = load(spark, sf_dir, "events").withColumn("split", split_col()).withColumn(
        "label", F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")))
    train = ev.filter(F.col("split") == "train")
    other = ev.filter(F.col("split") != "train")
    return L.unseen_labels(train, other, "label", by="split").select("split", "label")


def multilabel_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group = event_id div 4; gold = types at even ids, pred = types at odd ids."""
    ev = load(spark, sf_dir, "events").select("event_id", "event_type")
    vocab = L.label_list(ev, "event_type")
    enc = L.encode_label(ev, vocab, "event_type")
    g = enc.groupBy((F.col("event_id") / 4).cast("long").alias("grp")).agg(
        F.array_sort(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("label_id")))).alias("gold_ids"),
        F.array_sort(F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("label_id")))).alias("pred_ids"))
    n = vocab.count()
    g = g.withColumn("gold", L.encode_multihot(F.col("gold_ids"), n)).withColumn(
        "pred", L.encode_multihot(F.col("pred_ids"), n))
    sa = C.subset_accuracy(g, "pred", "gold")
    f1 = C.f1_micro_multilabel(g, "pred_ids", "gold_ids")
    return to_long(sa, []).unionByName(to_long(f1, []))


def corpus_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus id of every document's text, ids in first-seen (doc_id) order."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return L.dedupe_corpus(docs, "text", "doc_id", "corpus_id")


def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn picks among the true next assistant turn and the next two assistant
    turns in (conv_id, turn) order (wrapping); score = -|len(input) - 2 len(question)|."""
    conv = load(spark, sf_dir, "conversations")
    asst = with_row_id(conv.filter(F.col("role") == "assistant").select("conv_id", "turn", "text"),
                       ["conv_id", "turn"], "idx")
    n = F.lit(asst.count())
    user = conv.filter(F.col("role") == "user").select("conv_id", F.col("turn").alias("uturn"),
                                                       F.col("text").alias("question"))
    ex = user.join(asst.select("conv_id", (F.col("turn") - 1).alias("uturn"), "idx"), ["conv_id", "uturn"])
    ex = ex.withColumn("label", F.pmod(F.col("conv_id") + F.col("uturn"), F.lit(3)).cast("int"))
    # candidate j (0 = true answer) sits at position (label + j) % 3
    cand = ex.select("conv_id", "uturn", "question", "label",
                     F.posexplode(F.array(F.col("idx"), F.pmod(F.col("idx") + 1, n), F.pmod(F.col("idx") + 2, n)))
                      .alias("j", "cidx"))
    texts = asst.select(F.col("idx").alias("cidx"), F.col("text").alias("ending"))
    long = (cand.join(texts, "cidx")
                .withColumn("choice", F.pmod(F.col("label") + F.col("j"), F.lit(3)).cast("int")))
    wide = long.groupBy("conv_id", "uturn", "question", "label").pivot("choice", [0, 1, 2]).agg(F.first("ending"))
    wide = wide.withColumnRenamed("0", "ending0").withColumnRenamed("1", "ending1").withColumnRenamed("2", "ending2")
    ch = CH.explode_choices(wide, ["conv_id", "uturn"], ["ending0", "ending1", "ending2"], "{question} {ending}")
    ch = ch.withColumn("score", -F.abs(F.length("input_text") - 2 * F.length("question")))
    best = CH.best_choice(ch, ["conv_id", "uturn"]).join(ex.select("conv_id", "uturn", "label"), ["conv_id", "uturn"])
    wide_m = C.accuracy(best, "pred", "label")
    return to_long(wide_m, [])
