"""Extractive QA scoring.

Everything is per row on arrays: JVM normalisation, a linear Arrow-batched overlap count, JVM
F1 arithmetic; no explode and no shuffle beyond the single id join of predictions with references.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import answer_tokens, normalize_answer
from .metrics_table import as_list, to_long
from .prefix import prefix_sum


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def common_token_counts(pred_tokens: pd.Series, gold_tokens: pd.Series) -> pd.Series:
    """Per gold, the size of the multiset intersection with the prediction's tokens.

    A small Arrow-batched helper (linear Counter intersection); the arrays come from JVM normalisation.
    """
    out = []
    for p, golds in zip(pred_tokens, gold_tokens):
        if golds is None:
            out.append(None)
            continue
        cp = Counter(p) if p is not None else Counter()
        out.append([sum((cp & Counter(g)).values()) if g is not None else 0 for g in golds])
    return pd.Series(out)


def f1_from_counts(same: Column, n_pred: Column, n_gold: Column, v2: bool = False) -> Column:
    """Q9: token F1 from the overlap size. v1: 0 when nothing is shared; v2: 1 when both are
    empty, 0 when only one is."""
    prec, rec = same / n_pred, same / n_gold
    f1 = F.when(same == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
    if v2:
        f1 = F.when((n_pred == 0) | (n_gold == 0), (n_pred == n_gold).cast("double")).otherwise(f1)
    return f1


def exact_match(pred: Column, gold: Column) -> Column:
    """Q8: normalised equality as 0/1."""
    return (normalize_answer(pred) == normalize_answer(gold)).cast("double")


def has_answer(golds: str = "answers") -> Column:
    """Q13: the raw gold text list is non-empty."""
    return F.coalesce(F.size(F.col(golds)) > 0, F.lit(False))


def score_answers(preds: DataFrame, refs: DataFrame, ids, pred: str = "prediction_text",
                  golds: str = "answers", version: int = 1, keep=None) -> DataFrame:
    """Q10/Q12: per id, max over gold answers of exact match and token F1.

    v1: references ⟕ predictions; a missing prediction scores 0 but counts (J1); an id without
    golds is an error (decision R11). v2: inner join (J2); golds that normalise to empty are
    dropped, and ``['']`` stands in when none is left. ``keep``: reference columns carried along.
    """
    ids, keep = as_list(ids), as_list(keep)
    r = refs.select(*ids, *keep, F.col(golds).alias("_golds"))
    if version == 1:
        r = r.withColumn("_golds", F.when(F.size("_golds") > 0, F.col("_golds")).otherwise(
            F.raise_error(F.concat(F.lit("no gold answers for id "), F.concat_ws("/", *[F.col(i).cast("string") for i in ids])))))
    # every text is normalised once, to its tokens; the normalised text is their join
    tokens = F.transform("_golds", lambda x: F.struct(x.isNull().alias("none"), answer_tokens(x).alias("toks")))
    j = r.join(preds.select(*ids, F.col(pred).alias("_pred")), ids, "left" if version == 1 else "inner")
    j = j.withColumn("_ptok", answer_tokens(F.col("_pred"))).withColumn("_gtok", tokens)
    g = F.col("_gtok")
    if version == 2:
        kept = F.filter(g, lambda x: F.size(x["toks"]) > 0)
        g = F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(F.lit(False).alias("none"), F.array().cast("array<string>").alias("toks"))))
    j = (j.withColumn("_pnorm", F.when(F.col("_pred").isNotNull(), F.array_join("_ptok", " ")))
          .withColumn("_g", F.transform(g, lambda x: F.struct(
              F.when(~x["none"], F.array_join(x["toks"], " ")).alias("norm"), x["toks"].alias("toks")))))
    j = j.withColumn("_same", common_token_counts(F.col("_ptok"), F.transform(F.col("_g"), lambda x: x["toks"])))
    per_gold = F.zip_with(F.col("_g"), F.col("_same"), lambda x, c: F.struct(
        (x["norm"] == F.col("_pnorm")).cast("double").alias("em"),
        f1_from_counts(c, F.size(F.col("_ptok")), F.size(x["toks"]), version == 2).alias("f1")))
    j = j.withColumn("_s", per_gold)
    em = F.array_max(F.transform(F.col("_s"), lambda s: s["em"]))
    f1 = F.array_max(F.transform(F.col("_s"), lambda s: s["f1"]))
    missing = F.col("_pred").isNull()
    return j.select(*ids, *keep, F.col("_pred").alias(pred),
                    F.when(missing, F.lit(0.0)).otherwise(em).alias("exact"),
                    F.when(missing, F.lit(0.0)).otherwise(f1).alias("f1"))


def unanswered(refs: DataFrame, preds: DataFrame, ids) -> DataFrame:
    """Reference ids without a prediction."""
    ids = as_list(ids)
    return refs.select(*ids).join(preds.select(*ids), ids, "left_anti")


def squad_v1(preds: DataFrame, refs: DataFrame, ids, by=None, pred: str = "prediction_text",
             golds: str = "answers") -> DataFrame:
    """Q11: ``exact_match`` and ``f1`` ×100 over all references → long metrics."""
    by = as_list(by)
    s = score_answers(preds, refs, ids, pred, golds, 1, keep=by)
    wide = s.groupBy(*by).agg((100.0 * F.avg("exact")).alias("exact_match"), (100.0 * F.avg("f1")).alias("f1"))
    return to_long(wide, by)


def apply_na_threshold(scores: DataFrame, score: str, na_prob: str = "na_prob", has_ans: str = "has_ans",
                       thresh: float = 1.0) -> DataFrame:
    """Q14: above the threshold the prediction counts as "no answer": score = not has_answer."""
    return scores.withColumn(score, F.when(F.col(na_prob) > thresh, (~F.col(has_ans)).cast("double"))
                             .otherwise(F.col(score)))


def squad_v2_summary(raw: DataFrame, by=None, thresh: float = 1.0) -> DataFrame:
    """Q15: exact, f1, total overall and for HasAns_/NoAns_ slices (slices only when non-empty).

    ``raw`` has per id: exact, f1, has_ans, na_prob.
    """
    by = as_list(by)
    s = apply_na_threshold(apply_na_threshold(raw, "exact", thresh=thresh), "f1", thresh=thresh)
    ha, na = F.col("has_ans"), ~F.col("has_ans")
    wide = s.groupBy(*by).agg(
        (100.0 * F.avg("exact")).alias("exact"), (100.0 * F.avg("f1")).alias("f1"), F.count(F.lit(1)).alias("total"),
        (100.0 * F.avg(F.when(ha, F.col("exact")))).alias("HasAns_exact"),
        (100.0 * F.avg(F.when(ha, F.col("f1")))).alias("HasAns_f1"), F.count(F.when(ha, 1)).alias("HasAns_total"),
        (100.0 * F.avg(F.when(na, F.col("exact")))).alias("NoAns_exact"),
        (100.0 * F.avg(F.when(na, F.col("f1")))).alias("NoAns_f1"), F.count(F.when(na, 1)).alias("NoAns_total"))
    # a slice is reported only when it has ids: an empty slice's total becomes null, like its averages
    for sl in ("HasAns", "NoAns"):
        wide = wide.withColumn(f"{sl}_total", F.when(F.col(f"{sl}_total") > 0, F.col(f"{sl}_total")))
    long = to_long(wide, by)
    return long.filter(~(F.col("metric").rlike("^(HasAns|NoAns)_") & F.col("value").isNull()))


def best_threshold(raw: DataFrame, order, n_no_answer: DataFrame | None = None) -> DataFrame:
    """Q16: best no-answer threshold for exact and f1 (first strict maximum of the running score).

    Rows are taken in ``(na_prob, *order)`` order; the running score starts at the number of
    no-answer ids and adds the score (answerable), -1 (unanswerable but answered) or 0.
    ``raw`` per scored id: exact, f1, has_ans, na_prob, pred (text). The start count may come
    from all references (``n_no_answer`` one-row ``n``) or defaults to the scored ids.
    """
    order = as_list(order)
    answered = F.coalesce(F.length(F.col("pred")) > 0, F.lit(False))
    d = raw.select("na_prob", *order,
                   F.when(F.col("has_ans"), F.col("exact")).when(answered, -1.0).otherwise(0.0).alias("_de"),
                   F.when(F.col("has_ans"), F.col("f1")).when(answered, -1.0).otherwise(0.0).alias("_df"),
                   (~F.col("has_ans")).cast("long").alias("_noans"))
    c = prefix_sum(d, ["na_prob", *order], ["_de", "_df"], ["_ce", "_cf"])
    # earliest row among equal running scores: larger negated order key (numeric order columns)
    key = F.struct(*[(-F.col(o)).alias(o) for o in ["na_prob", *order]])
    agg = c.agg(F.count(F.lit(1)).alias("n"), F.sum("_noans").alias("start"),
                F.max("_ce").alias("mce"), F.max_by("na_prob", F.struct(F.col("_ce"), key)).alias("te"),
                F.max("_cf").alias("mcf"), F.max_by("na_prob", F.struct(F.col("_cf"), key)).alias("tf"))
    if n_no_answer is not None:
        agg = agg.drop("start").withColumn("_k", F.lit(0)).join(
            n_no_answer.select(F.col("n").alias("start")).withColumn("_k", F.lit(0)), "_k").drop("_k")
    best_e = F.col("start") + F.greatest(F.col("mce"), F.lit(0.0))
    best_f = F.col("start") + F.greatest(F.col("mcf"), F.lit(0.0))
    wide = agg.select(
        (100.0 * best_e / F.col("n")).alias("best_exact"),
        F.when(F.col("mce") > 0, F.col("te")).otherwise(0.0).alias("best_exact_thresh"),
        (100.0 * best_f / F.col("n")).alias("best_f1"),
        F.when(F.col("mcf") > 0, F.col("tf")).otherwise(0.0).alias("best_f1_thresh"))
    return to_long(wide, [])


# ---------------------------------------------------------------- post-processing (Q1-Q7)

_CAND_FIELDS = [("kind", T.IntegerType()), ("s", T.IntegerType()), ("e", T.IntegerType()), ("score", T.FloatType()),
                ("start_logit", T.FloatType()), ("end_logit", T.FloatType()), ("char_start", T.IntegerType()),
                ("char_end", T.IntegerType())]
_CAND_TYPE = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _CAND_FIELDS]))


def _candidates_udf(n_best: int, max_answer_len: int, use_max_context: bool):
    @F.arrow_udf(_CAND_TYPE)
    def cands(starts: pa.Array, ends: pa.Array, offsets: pa.Array, context: pa.Array) -> pa.Array:
        def sizes(a: pa.Array) -> np.ndarray:
            return pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)

        def padded(a: pa.Array, flat: np.ndarray, some: np.ndarray, width: int) -> np.ndarray:
            """Lists of some rows as rows of a matrix, zero beyond their ends."""
            n = sizes(a)
            first = np.cumsum(n) - n
            at = np.arange(width)
            inside = at < n[some, None]
            return np.where(inside, flat[np.where(inside, first[some, None] + at, 0)] if len(flat) else 0, 0)

        places = offsets.flatten()
        has_all = places.is_valid().to_numpy(zero_copy_only=False)
        begin, close = (pc.fill_null(pc.struct_field(places, f), 0).to_numpy(zero_copy_only=False) for f in ("start", "end"))
        logits = [x.flatten().to_numpy(zero_copy_only=False).astype(np.float32) for x in (starts, ends)]
        n_off, given = sizes(offsets), context.is_valid().to_numpy(zero_copy_only=False)
        marks = pc.fill_null(context.flatten(), False).to_numpy(zero_copy_only=False).astype(bool) if use_max_context else None
        shape = sizes(starts) * (1 << 32) + sizes(ends)
        parts = []
        for key in np.unique(shape):  # features with as many logits are scored together
            ns, ne = divmod(int(key), 1 << 32)
            rows = np.flatnonzero(shape == key)
            for lo in range(0, len(rows), 1024):
                some = rows[lo:lo + 1024]
                wide = max(int(n_off[some].max()), ns, ne, 1)
                sl, el = (padded(x, f, some, max(n, 1)) for x, f, n in ((starts, logits[0], ns), (ends, logits[1], ne)))
                has, ost, oen = (padded(offsets, f, some, wide) for f in (has_all, begin, close))
                # the best places in ascending order: pairs come by (start, end), a stable sort by score keeps that for ties
                ts, te = (np.sort(np.argsort(-x[:, :n], axis=1, kind="stable")[:, :n_best], axis=1) for x, n in ((sl, ns), (el, ne)))
                s = np.repeat(ts, te.shape[1], axis=1)
                e = np.tile(te, (1, ts.shape[1]))
                ok = (np.take_along_axis(has, s, 1) & np.take_along_axis(has, e, 1) & (e >= s) & (e - s + 1 <= max_answer_len)).astype(bool)
                if use_max_context:
                    mc = padded(context, marks, some, wide).astype(bool)
                    ok &= np.take_along_axis(mc, s, 1) | ~given[some, None]
                sc = np.take_along_axis(sl, s, 1) + np.take_along_axis(el, e, 1)
                order = np.argsort(np.where(ok, -sc, np.inf), axis=1, kind="stable")[:, :n_best]
                # a sum that is no number sorts behind the pairs that don't count: bring those that do to the front
                order = np.take_along_axis(order, np.argsort(~np.take_along_axis(ok, order, 1), axis=1, kind="stable"), 1)
                s, e, sc, ok = (np.take_along_axis(x, order, 1) for x in (s, e, sc, ok))
                zero, one = np.zeros((len(some), 1), np.int64), np.ones((len(some), 1), np.int64)
                none = np.full((len(some), 1), np.nan, np.float32)
                s0, e0 = (sl[:, :1], el[:, :1]) if ns and ne else (none, none)
                keep = np.concatenate([ok, one.astype(bool)], axis=1)
                cols = [np.concatenate(x, axis=1)[keep] for x in (
                    (np.zeros_like(s), one), (s, zero), (e, zero), (sc, s0 + e0), (np.take_along_axis(sl, s, 1), s0), (np.take_along_axis(el, e, 1), e0),
                    (np.take_along_axis(ost, s, 1), zero), (np.take_along_axis(oen, e, 1), zero))]
                parts.append((np.repeat(some, keep.sum(axis=1)), cols))
        kinds = [np.float32 if isinstance(t, T.FloatType) else np.int32 for _, t in _CAND_FIELDS]
        row = np.concatenate([r for r, _ in parts]) if parts else np.zeros(0, np.int64)
        back = np.argsort(row, kind="stable")
        cols = [pa.array((np.concatenate([c[k] for _, c in parts]) if parts else np.zeros(0))[back].astype(t)) for k, t in enumerate(kinds)]
        at = pa.array(np.searchsorted(row[back], np.arange(len(starts) + 1)).astype(np.int32))
        return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(cols, names=[n for n, _ in _CAND_FIELDS]))
    return cands


def span_candidates(features: DataFrame, n_best: int = 20, max_answer_len: int = 30,
                    max_context: str | None = None) -> DataFrame:
    """Q1/Q2/J5/Q3 per feature: rows ``(example_id, feature, kind, s, e, score, start_logit,
    end_logit, char_start, char_end)``; kind 0 = span, 1 = the feature's null score.

    ``features``: example_id, feature (order within the example), start_logits, end_logits,
    offsets (array<struct<start,end>>, null outside the context) and optionally a
    ``max_context`` array<boolean> per position. Per feature: top ``n_best`` start and end indexes
    (ties: lower index), the valid pairs (both in context, ordered, at most ``max_answer_len``
    tokens), the best ``n_best`` of them (score desc, start, end) and the null score — one
    numpy step over Arrow batches, no shuffle.
    """
    mc = F.col(max_context) if max_context else F.lit(None).cast("array<boolean>")
    c = _candidates_udf(n_best, max_answer_len, bool(max_context))(
        F.col("start_logits"), F.col("end_logits"), F.col("offsets"), mc)
    # inline_outer: a plain generator makes Catalyst infer size(...) > 0 below the projection and
    # evaluate the candidate step twice; the array is never empty (it holds the null score)
    return features.select("example_id", "feature", c.alias("_c")).select("example_id", "feature", F.inline_outer("_c"))


def nbest(cands: DataFrame, contexts: DataFrame, n_best: int = 20, with_null: bool = True) -> DataFrame:
    """Q3-Q6: per example the ``n_best`` spans by score (ties: span before null, then feature, start,
    end), the minimum null score (v2) kept even when cut, answer text sliced from the context,
    the fake ``"empty"`` answer when nothing non-empty is left, and softmax probabilities.

    ``contexts``: example_id, context. Returns example_id, rank (0-based), kind, text, score,
    start_logit, end_logit, probability; an example whose features hold no valid span comes with the fake answer.

    Candidates are read once: spans and nulls are ranked apart within one partition of the window, and a rank limit cuts
    both before and after the shuffle; what is left of an example, at most ``n_best`` spans and a null, is one array.
    """
    # of spans the n best, of nulls the least; the rank orders each kind so that one limit serves both
    place = F.when(F.col("kind") == 0, -F.col("score")).otherwise(F.col("score"))
    w = Window.partitionBy("example_id", "kind").orderBy(place, "feature", "s", "e")
    kept = cands.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_best).filter((F.col("kind") == 0) | (F.col("_r") == 1))
    row = F.struct((-F.col("score")).alias("neg"), "kind", "feature", "s", "e", "score", "start_logit", "end_logit", "char_start", "char_end")
    g = kept.groupBy("example_id").agg(F.array_sort(F.collect_list(row)).alias("_all"))
    if with_null:
        # the null counts for the cut, and stays behind it
        shown = F.filter("_all", lambda x, i: (i < n_best) | (x["kind"] == 1))
    else:
        shown = F.slice(F.filter("_all", lambda x: x["kind"] == 0), 1, n_best)
    g = g.select("example_id", shown.alias("_all")).join(contexts.select("example_id", "context"), "example_id", "left")
    text = F.transform("_all", lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"] == 1, "").otherwise(
        F.coalesce(F.substring(F.col("context"), x["char_start"] + 1, x["char_end"] - x["char_start"]), F.lit(""))).alias("text"),
        x["score"].alias("score"), x["start_logit"].alias("start_logit"), x["end_logit"].alias("end_logit")))
    g = g.select("example_id", text.alias("_t"))
    zero = F.lit(0.0).cast("float")
    fake = F.array(F.struct(F.lit(2).alias("kind"), F.lit("empty").alias("text"), zero.alias("score"), zero.alias("start_logit"), zero.alias("end_logit")))
    blank = (F.size("_t") == 0) | ((F.size("_t") == 1) & (F.get("_t", F.lit(0))["text"] == ""))
    g = g.select("example_id", F.when(blank, F.concat(fake, "_t")).otherwise(F.col("_t")).alias("_t"))
    g = g.withColumn("_top", F.array_max(F.transform("_t", lambda x: x["score"].cast("double"))))
    g = g.withColumn("_sum", F.aggregate("_t", F.lit(0.0), lambda a, x: a + F.exp(x["score"].cast("double") - F.col("_top"))))
    x = g.select("example_id", "_top", "_sum", F.posexplode("_t").alias("rank", "_x"))
    return x.select("example_id", "rank", "_x.kind", "_x.text", "_x.score", "_x.start_logit", "_x.end_logit",
                    (F.exp(F.col("_x.score").cast("double") - F.col("_top")) / F.col("_sum")).alias("probability"))


def pick_answer(nb: DataFrame, v2: bool = True, null_score_diff_threshold: float = 0.0) -> DataFrame:
    """Q7: v1 = first of the n-best; v2 = best non-empty answer unless the null score beats it by more
    than the threshold (then ''); emits ``score_diff`` (null odds). No non-empty answer → '' (R14)."""
    if not v2:
        return nb.groupBy("example_id").agg(F.min_by("text", "rank").alias("prediction_text"))
    g = nb.groupBy("example_id").agg(
        F.min_by(F.struct("text", "start_logit", "end_logit"), F.when(F.col("text") != "", F.col("rank"))).alias("_b"),
        F.max(F.when(F.col("kind") == 1, F.col("score"))).alias("_null"))
    diff = F.col("_null") - F.col("_b.start_logit") - F.col("_b.end_logit")
    pred = F.when(F.col("_b").isNull(), F.lit("")).when(diff > null_score_diff_threshold, F.lit("")).otherwise(F.col("_b.text"))
    return g.select("example_id", pred.alias("prediction_text"), diff.cast("double").alias("score_diff"))


def format_qa(answers: DataFrame, refs: DataFrame, v2: bool, id_col: str = "id", pred: str = "prediction_text",
              answers_col: str = "answers") -> tuple[DataFrame, DataFrame]:
    """Q17: predictions ``(id string, prediction_text[, no_answer_probability 0.0])`` and references
    ``(id string, answers)`` in the metric schema."""
    p = answers.select(F.col(id_col).cast("string").alias("id"), F.col(pred).alias("prediction_text"))
    if v2:
        p = p.withColumn("no_answer_probability", F.lit(0.0))
    r = refs.select(F.col(id_col).cast("string").alias("id"), F.col(answers_col).alias("answers"))
    return p, r
