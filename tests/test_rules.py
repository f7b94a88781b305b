"""Hand cases for the metric rules, each checked against a pure-Python statement of the rule."""

import math
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nluscore.functions import text as TX
from nluscore.operators import classify as C
from nluscore.operators import qa as Q
from nluscore.operators import seq as S


# ---------------------------------------------------------------- answer normalisation

def py_norm(s):
    s = s.lower()
    s = "".join(ch for ch in s if ch not in set(string.punctuation))
    s = re.sub(r"\b(a|an|the)\b", " ", s, flags=re.UNICODE)
    return " ".join(s.split())


def py_f1(pred, gold, v2):
    pt, gt = py_norm(pred).split(), py_norm(gold).split()
    common = sum((Counter(pt) & Counter(gt)).values())
    if v2 and (not pt or not gt):
        return float(pt == gt)
    if common == 0:
        return 0.0
    p, r = common / len(pt), common / len(gt)
    return 2 * p * r / (p + r)


CASES = ["The cat", "a an the", "Théâtre: the END!", "an apple, an-apple", "  x y z \x1c w ",
         "the_the", "ÀB the²", "", "A", "It's the thé", "the.the", "tab\tnew\nline"]


def test_normalize_matches_python(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "s string")
    got = [r[0] for r in df.select(TX.normalize_answer("s")).collect()]
    assert got == [py_norm(c) for c in CASES]


@pytest.mark.parametrize("v2", [False, True])
def test_token_f1_matches_python(spark, v2):
    pairs = [("the cat sat", "a cat sat down"), ("", ""), ("", "x"), ("x x y", "x y y"), ("The", "the"), ("a b", "c d")]
    df = spark.createDataFrame([(i, p, [g]) for i, (p, g) in enumerate(pairs)], "id int, p string, g array<string>")
    refs = df.select("id", F.col("g").alias("answers"))
    preds = df.select("id", F.col("p").alias("prediction_text"))
    got = {r["id"]: (r["exact"], r["f1"]) for r in Q.score_answers(preds, refs, ["id"], version=2 if v2 else 1).collect()}
    for i, (p, g) in enumerate(pairs):
        g_eff = g if (not v2 or py_norm(g)) else ""
        assert got[i][0] == float(py_norm(p) == py_norm(g_eff))
        assert math.isclose(got[i][1], py_f1(p, g_eff, v2), abs_tol=1e-12)


def test_squad_v1_missing_prediction_counts_zero(spark):
    refs = spark.createDataFrame([(1, ["x"]), (2, ["y"])], "id int, answers array<string>")
    preds = spark.createDataFrame([(1, "x")], "id int, prediction_text string")
    got = {r["metric"]: r["value"] for r in Q.squad_v1(preds, refs, ["id"]).collect()}
    assert got == {"exact_match": 50.0, "f1": 50.0}
    assert [r[0] for r in Q.unanswered(refs, preds, ["id"]).collect()] == [2]


# ---------------------------------------------------------------- best threshold (Q16)

def py_best(rows, key):
    """rows: (qid, has_ans, pred, score, na_prob); literal running-score rule."""
    cur = sum(1 for r in rows if not r[1])
    best, thr = cur, 0.0
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        diff = r[3] if r[1] else (-1 if r[2] else 0)
        cur += diff
        if cur > best:
            best, thr = cur, r[4]
    return 100.0 * best / len(rows), thr


def test_best_threshold_matches_python(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        has = bool(rng.integers(0, 2))
        pred = "" if rng.random() < 0.3 else "x"
        score = float(rng.integers(0, 2)) if has else 0.0
        rows.append((i, has, pred, score, float(rng.integers(0, 10)) / 10))
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[3], r[4]) for r in rows],
                               "qid long, has_ans boolean, pred string, exact double, f1 double, na_prob double")
    got = {r["metric"]: r["value"] for r in Q.best_threshold(df, ["qid"]).collect()}
    be, bt = py_best(rows, 3)
    assert math.isclose(got["best_exact"], round(be, 6), abs_tol=1e-6)
    assert got["best_exact_thresh"] == bt


# ---------------------------------------------------------------- chunks (N1) against the literal rule

def py_entities(seq):
    def end_of(pt, t, ptype, typ):
        return (pt in "ES" or (pt in "BI" and t in "BSO")) or (pt not in ("O", ".") and ptype != typ)

    def start_of(pt, t, ptype, typ):
        return (t in "BS" or (pt in "ES" and t in "EI") or (pt == "O" and t in "EI")
                or (t not in ("O", ".") and ptype != typ))

    prev_tag, prev_type, begin, chunks = "O", "", 0, []
    for i, chunk in enumerate(seq + ["O"]):
        tag = chunk[0]
        typ = chunk[1:].split("-", maxsplit=1)[-1] or "_"
        if end_of(prev_tag, tag, prev_type, typ):
            chunks.append((prev_type, begin, i - 1))
        if start_of(prev_tag, tag, prev_type, typ):
            begin = i
        prev_tag, prev_type = tag, typ
    return chunks


SEQS = [
    ["B-PER", "I-PER", "O", "B-LOC"],
    ["I-PER", "I-PER", "B-PER", "E-PER", "S-LOC", "O"],
    ["NOUN", "NOUN", "VERB", "ADJ", "NOUN"],
    ["B-X", "I-Y", "I-Y", "O", "E-X", "E-X"],
    ["O", "O"],
    [],
    ["S-A", "S-A", "B-A", "E-A", "I-A"],
    [".", "B-X", ".", "I-X"],
]


def test_chunks_match_literal_rule(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SEQS)], "id int, tags array<string>")
    got = {r["id"]: [tuple(e) for e in r["entities"]] for r in S.extract_entities(df, "tags").collect()}
    for i, s in enumerate(SEQS):
        assert got[i] == py_entities(s), (s, got[i])


def test_entity_report_counts(spark):
    df = spark.createDataFrame([(["B-PER", "I-PER", "O", "B-LOC"], ["B-PER", "I-PER", "O", "B-PER"])],
                               "g array<string>, p array<string>")
    df = S.extract_entities(S.extract_entities(df, "g", "ge"), "p", "pe")
    rep = {(r["type"], r["metric"]): r["value"] for r in S.entity_report(df, "ge", "pe").collect()}
    assert rep[("PER", "precision")] == 0.5 and rep[("PER", "recall")] == 1.0
    assert rep[("LOC", "recall")] == 0.0 and rep[("LOC", "number")] == 1.0
    assert rep[("overall", "f1")] == round(2 * 0.5 * 0.5 / 1.0, 6)


# ---------------------------------------------------------------- classification (M4-M9)

def test_f1_mcc_multiclass(spark):
    gold = [0, 1, 2, 2, 1, 0, 2, 1]
    pred = [0, 2, 2, 2, 1, 0, 1, 1]
    df = spark.createDataFrame(list(zip(pred, gold)), "pred int, gold int")
    m = C.class_metrics(df, "pred", "gold").first()
    labels = sorted(set(gold) | set(pred))
    f1s, sup = [], []
    for c in labels:
        tp = sum(p == g == c for p, g in zip(pred, gold))
        fp = sum(p == c != g for p, g in zip(pred, gold))
        fn = sum(g == c != p for p, g in zip(pred, gold))
        f1s.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
        sup.append(sum(g == c for g in gold))
    assert math.isclose(m["f1_macro"], sum(f1s) / len(f1s))
    assert math.isclose(m["f1_weighted"], sum(f * s for f, s in zip(f1s, sup)) / sum(sup))
    assert math.isclose(m["f1_micro"], sum(p == g for p, g in zip(pred, gold)) / len(gold))
    cm = np.zeros((3, 3))
    for p, g in zip(pred, gold):
        cm[g, p] += 1
    t, pk, c, s = cm.sum(1), cm.sum(0), np.trace(cm), cm.sum()
    mcc = (c * s - (t * pk).sum()) / math.sqrt((s * s - (pk * pk).sum()) * (s * s - (t * t).sum()))
    assert math.isclose(m["mcc"], mcc)


def test_pearson_constant_is_nan_not_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert math.isnan(C.pearson(df, "x", "y").first()[0])


def test_spearman_ties(spark):
    x = [1, 2, 2, 3, 5, 5, 5, 0]
    y = [3, 1, 4, 1, 5, 9, 2, 6]
    df = spark.createDataFrame(list(zip(x, y)), "x long, y long")

    def avg_rank(v):
        order = sorted(v)
        return [order.index(a) + 1 + (order.count(a) - 1) / 2 for a in v]
    rx, ry = np.array(avg_rank(x)), np.array(avg_rank(y))
    want = np.corrcoef(rx, ry)[0, 1]
    assert math.isclose(C.spearman(df, "x", "y").first()[0], want, rel_tol=1e-9)


def test_argmax_first_max_and_nan(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([float("nan"), 5.0],), ([2.0],)], "a array<double>")
    assert [r[0] for r in df.select(TX.argmax("a")).collect()] == [1, 0, 0]


# ---------------------------------------------------------------- strict schemes

@pytest.mark.parametrize("scheme,tags,want", [
    ("IOB2", ["B-A", "I-A", "I-B", "B-B", "O", "I-A"], [("A", 0, 1), ("B", 3, 3)]),
    ("IOB1", ["I-A", "I-A", "B-A", "O", "I-B"], [("A", 0, 1), ("A", 2, 2), ("B", 4, 4)]),
    ("IOE2", ["I-A", "E-A", "I-B", "O", "E-A"], [("A", 0, 1), ("A", 4, 4)]),
    ("IOE1", ["I-A", "E-A", "I-A", "O"], [("A", 0, 1), ("A", 2, 2)]),
    ("IOBES", ["B-A", "I-A", "E-A", "S-B", "B-A", "I-A", "O"], [("A", 0, 2), ("B", 3, 3)]),
    ("BILOU", ["U-A", "B-B", "L-B", "B-A", "O"], [("A", 0, 0), ("B", 1, 2)]),
])
def test_strict_schemes(scheme, tags, want):
    assert S.strict_chunks(tags, scheme) == want


def test_strict_rejects_bad_prefix_and_scheme():
    with pytest.raises(ValueError):
        S.strict_chunks(["S-A"], "IOB2")
    with pytest.raises(ValueError):
        S.strict_chunks(["B-A"], "XYZ")


def test_strict_udf(spark):
    df = spark.createDataFrame([(["B-A", "I-A", "O", "B-B"],)], "t array<string>")
    got = [tuple(e) for e in S.extract_entities_strict(df, "t", "IOB2").first()["entities"]]
    assert got == [("A", 0, 1), ("B", 3, 3)]


def test_squad_v2_empty_slice_not_reported(spark):
    raw = spark.createDataFrame([(1, 1.0, 1.0, True, 0.1), (2, 0.0, 0.5, True, 0.2)],
                                "qid long, exact double, f1 double, has_ans boolean, na_prob double")
    got = {r["metric"]: r["value"] for r in Q.squad_v2_summary(raw).collect()}
    assert got == {"exact": 50.0, "f1": 75.0, "total": 2.0, "HasAns_exact": 50.0, "HasAns_f1": 75.0, "HasAns_total": 2.0}
