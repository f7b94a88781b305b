"""Fixture queries for classification and regression metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators.metrics_table import to_long
from ..operators.report import macro_average
from .tables import classification_input, regression_input


def accuracy_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, M16 per language, G1 macro average over languages."""
    cls = classification_input(spark, sf_dir)
    wide = C.accuracy(cls, "pred", "gold", "config", weight="weight")
    long = to_long(wide, ["config"], ["accuracy", "accuracy_weighted", "correct_weighted", "samples"])
    avg = macro_average(long.filter(F.col("metric") == "accuracy"), [], "config", label="avg")
    return long.unionByName(avg)


def f1_mcc_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M5, M7, M13 per language: F1 binary/micro/macro/weighted, MCC, combined score."""
    cls = classification_input(spark, sf_dir)
    wide = C.combined_score(C.class_metrics(cls, "pred", "gold", "config"), ["accuracy", "f1"])
    return to_long(wide, ["config"])


def pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 and M9 of l_quantity against l_extendedprice."""
    li = regression_input(spark, sf_dir)
    p = C.pearson(li, "pred", "gold")
    s = C.spearman(li, "pred", "gold")
    return to_long(p, []).unionByName(to_long(s, []))


def weighted_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 with weights, one scan: mse, rmse, mse_weighted, rmse_weighted."""
    li = regression_input(spark, sf_dir)
    return to_long(C.regression_metrics(li, "pred", "gold", weight="weight"), [])


def custom_metric_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: a user's balanced accuracy (mean recall of the classes) and count per language, as mergeable states."""
    from ..operators.registry import custom_metric_states as run

    def update(state, rows):
        for gold, pred in zip(rows["gold"], rows["pred"]):
            hit, n = state.get(gold, (0, 0))
            state[gold] = (hit + (gold == pred), n + 1)
        return state

    def merge(a, b):
        return {k: (a.get(k, (0, 0))[0] + b.get(k, (0, 0))[0], a.get(k, (0, 0))[1] + b.get(k, (0, 0))[1]) for k in {*a, *b}}

    def finish(state):
        return {"balanced_accuracy": round(sum(h / n for h, n in state.values()) / len(state), 6), "rows": sum(n for _, n in state.values())}

    df = classification_input(spark, sf_dir).select("config", "gold", "pred")
    return run(df, dict, update, merge, finish, "balanced_accuracy double, rows long", by="config")
