"""Fixture queries for token windows, span labels, tag alignment and entity metrics over documents.

Tags: a word whose first character is an upper-case letter belongs to an entity of type ``lang``;
consecutive such words form one entity (B- then I-). Predictions use the same rule restricted to
words longer than 3 characters.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.slices import in_slices
from ..functions.text import split_ws
from ..operators import labels as L
from ..operators import seq as S
from ..operators import tokens as T
from ..operators.passages import find_passages
from .tables import load

WINDOW, OVERLAP = 128, 32
PIECE = 4


@lru_cache(maxsize=1)
def _upper_case() -> np.ndarray:
    """Whether each code point is an upper-case letter (Unicode Lu)."""
    return np.array([unicodedata.category(chr(c)) == "Lu" for c in range(sys.maxunicode + 1)])


def _word_tags_udf(min_lens: dict[str, int]):
    @F.arrow_udf("struct<" + ", ".join(f"{n}: array<string>" for n in min_lens) + ">")
    @in_slices
    def tags(text: pa.Array, lang: pa.Array) -> pa.Array:
        starts, ends, bounds, first = T.word_edges(text.to_pylist())
        types = lang.fill_null("_").dictionary_encode()
        kind = np.repeat(types.indices.to_numpy(zero_copy_only=False), np.diff(bounds)).astype(np.int64)
        names = ["O", *(p + t for t in types.dictionary.to_pylist() for p in ("B-", "I-"))]
        upper, opens = _upper_case()[first], np.zeros(len(first) + 1, dtype=bool)
        opens[bounds] = True
        out = []
        for least in min_lens.values():
            cap = upper & (ends - starts > least)
            inside = np.concatenate(([False], cap[:-1])) & ~opens[:-1] if len(cap) else cap
            code = np.where(cap, 1 + 2 * kind + inside, 0)
            out.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(names, pa.string()).take(pa.array(code))))
        return pa.StructArray.from_arrays(out, names=list(min_lens))
    return tags


def tagged(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds gold_tags and pred_tags: B-/I-<lang> for runs of words starting with an upper-case letter (Unicode Lu), the
    predicted ones only of words longer than 3 characters, else O."""
    d = docs.withColumn("_tags", _word_tags_udf({"gold": 0, "pred": 3})(F.col(text), F.col(lang)))
    return d.withColumns({"gold_tags": F.col("_tags.gold"), "pred_tags": F.col("_tags.pred")}).drop("_tags")


def doc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128-token windows sharing 32 tokens, with token and character bounds."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    w = T.window_bounds(T.window_tokens(T.tokenize_offsets(docs), "n_tokens", WINDOW, OVERLAP))
    return w.select("doc_id", *[F.col(c).cast("long").alias(c) for c in
                                ("window_id", "tok_start", "tok_end", "char_start", "char_end")],
                    (F.col("tok_end") - F.col("tok_start")).cast("long").alias("n_tokens"))


def span_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: a benchmark passage found in a document is the answer; label every window of that document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    bench = load(spark, sf_dir, "benchmark").select("item_id", "text")
    found = find_passages(docs, bench)
    ex = (found.join(bench.select("item_id", F.length("text").alias("alen")), "item_id")
               .select("doc_id", "item_id", F.col("start").alias("start_char"),
                       (F.col("start") + F.col("alen")).alias("end_char")))
    ctx = docs.join(ex, "doc_id")
    w = T.window_tokens(T.tokenize_offsets(ctx), "n_tokens", WINDOW, OVERLAP)
    lab = T.span_labels(w, "start_char", "end_char", max_len=WINDOW)
    return lab.select("doc_id", "item_id", F.col("window_id").cast("long").alias("window_id"),
                      F.col("start_position").cast("long").alias("start_position"),
                      F.col("end_position").cast("long").alias("end_position"))


def pair_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn after it, cut together to 24 tokens less three special ones.

    The texts are shuffled, not their words, and meet once for all strategies."""
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("first"))
    second = conv.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("second"))
    pairs = first.join(second, ["conv_id", "turn"]).select("conv_id", "turn", split_ws("first").alias("first"), split_ws("second").alias("second"))
    cut = []
    for k, strategy in enumerate(("longest_first", "only_second", "only_first")):
        a, b, error = f"first{k}", f"second{k}", f"error{k}"
        pairs = T.truncate_pair(pairs.withColumns({a: F.col("first"), b: F.col("second")}), a, b, 24, strategy, special=3)
        pairs = pairs.withColumnRenamed("truncation_error", error)
        cut.append(F.struct(F.lit(strategy).alias("strategy"), F.array_join(a, " ").alias("first"), F.array_join(b, " ").alias("second"),
                            F.col(error).alias("truncation_error")))
    return pairs.select("conv_id", "turn", F.inline_outer(F.array(*cut)))


def _tagged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(load(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def align_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words cut into 4-character pieces; first piece labelled, others -100 or B→I."""
    d = _tagged_docs(spark, sf_dir).select("doc_id", split_ws("text").alias("words"), "gold_tags")
    vocab = L.label_list(d, "gold_tags", multi=True)
    b2i = L.b_to_i(vocab)
    out = T.align_tags(d, "words", "gold_tags", PIECE, vocab, b2i)
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("word_id").cast("long").alias("word_id"),
                      "label_id", "label_all_id")


def entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type precision/recall/f1/number, overall micro scores and token accuracy."""
    return S.entity_report_from_tags(_tagged_docs(spark, sf_dir), "gold_tags", "pred_tags")


def entity_report_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 (chunks as rows), N3-N5, J10, N6: the same report per language from extracted entities, flattened names."""
    d = _tagged_docs(spark, sf_dir).select(F.coalesce("lang", F.lit("_")).alias("lang"), "gold_tags", "pred_tags")
    d = S.extract_entities(S.extract_entities(d, "gold_tags", "gold_ents"), "pred_tags", "pred_ents")
    r = S.entity_report(d, "gold_ents", "pred_ents", by="lang", gold_tags="gold_tags", pred_tags="pred_tags")
    return S.flatten_report(r, overall_only=True).select("lang", "metric", "value")
