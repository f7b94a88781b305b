"""Classification and regression metrics (accuracy, F1 family, MCC, Pearson, Spearman, MSE).

Every metric is an aggregate over the input: one scan with map-side partial aggregation, then
tiny per-key tables. Class metrics all start from one confusion table ``(by, gold, pred, n)``
whose size is bounded by the number of classes, never by the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics_table import as_list, safe_ratio
from .prefix import average_ranks


def _w(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def _hit(pred: Column, gold: Column) -> Column:
    """1.0 or 0.0; a missing prediction is wrong, a row without gold label has no hit."""
    return F.when(gold.isNotNull(), F.coalesce(pred == gold, F.lit(False)).cast("double"))


def accuracy(df: DataFrame, pred: str, gold: str, by=None, weight: str | None = None) -> DataFrame:
    """M1/M2/M16 in one scan: accuracy and samples; with a weight column also
    ``accuracy_weighted`` (sum(w*hit)/sum(w)) and the un-normalised ``correct_weighted``."""
    by = as_list(by)
    hit = _hit(F.col(pred), F.col(gold))
    aggs = [F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("samples")]
    if weight:
        w = _w(weight)
        aggs += [safe_ratio(F.sum(w * hit), F.sum(F.when(hit.isNotNull(), w))).alias("accuracy_weighted"),
                 F.sum(w * hit).alias("correct_weighted")]
    return df.groupBy(*by).agg(*aggs)


def subset_accuracy(df: DataFrame, pred: str, gold: str, by=None, as_sets: bool = False) -> DataFrame:
    """M3: multi-label subset accuracy: equal multi-hot vectors (or equal label sets with ``as_sets``)."""
    by = as_list(by)
    p, g = F.col(pred), F.col(gold)
    if as_sets:
        p, g = F.array_sort(F.array_distinct(p)), F.array_sort(F.array_distinct(g))
    hit = _hit(p, g)
    return df.groupBy(*by).agg(F.avg(hit).alias("subset_accuracy"), F.count(F.lit(1)).alias("samples"))


def confusion(df: DataFrame, pred: str, gold: str, by=None, weight: str | None = None) -> DataFrame:
    """Confusion table ``(by..., gold, pred, n)``; one shuffle of at most classes² rows per key."""
    by = as_list(by)
    return (df.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred"))
              .agg(F.sum(_w(weight)).alias("n")))


def class_counts(conf: DataFrame, by=None) -> DataFrame:
    """Per class ``tp, fp, fn, support`` from a confusion table (tiny input).

    A missing prediction is a false negative of its gold class and no class of its own; rows without
    gold label don't count.
    """
    by = as_list(by)
    conf = conf.filter(F.col("gold").isNotNull())
    wrong = ~F.col("gold").eqNullSafe(F.col("pred"))
    as_gold = conf.select(*by, F.col("gold").alias("label"),
                          F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0.0).alias("tp"),
                          F.lit(0.0).alias("fp"),
                          F.when(wrong, F.col("n")).otherwise(0.0).alias("fn"),
                          F.col("n").alias("support"))
    as_pred = conf.filter(F.col("pred").isNotNull()).select(
                          *by, F.col("pred").alias("label"), F.lit(0.0).alias("tp"),
                          F.when(wrong, F.col("n")).otherwise(0.0).alias("fp"),
                          F.lit(0.0).alias("fn"), F.lit(0.0).alias("support"))
    return (as_gold.unionByName(as_pred).groupBy(*by, "label")
                   .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")]))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_ratio(2 * tp, 2 * tp + fp + fn)


def f1(df: DataFrame, pred: str, gold: str, by=None, average: str = "binary", pos_label=1,
       labels: Sequence | None = None, weight: str | None = None, name: str | None = None) -> DataFrame:
    """M4/M5: F1 with ``average`` in binary, micro, macro, weighted, or None (per class).

    Zero division gives 0. ``labels`` restricts the classes taken into the average.
    """
    by = as_list(by)
    cc = class_counts(confusion(df, pred, gold, by, weight), by)
    if labels is not None:
        cc = cc.filter(F.col("label").isin(list(labels)))
    tp, fp, fn, sup = (F.col(c) for c in ("tp", "fp", "fn", "support"))
    if average is None:
        return cc.select(*by, "label", safe_ratio(tp, tp + fp).alias("precision"),
                         safe_ratio(tp, tp + fn).alias("recall"), _f1(tp, fp, fn).alias("f1"), sup.alias("support"))
    out = name or ("f1" if average == "binary" else f"f1_{average}")
    if average == "binary":
        res = cc.groupBy(*by).agg(F.sum(F.when(F.col("label") == F.lit(pos_label), _f1(tp, fp, fn)).otherwise(0.0)).alias(out))
    elif average == "micro":
        res = cc.groupBy(*by).agg(_f1(F.sum(tp), F.sum(fp), F.sum(fn)).alias(out))
    elif average == "macro":
        res = cc.groupBy(*by).agg(F.avg(_f1(tp, fp, fn)).alias(out))
    elif average == "weighted":
        res = cc.groupBy(*by).agg(safe_ratio(F.sum(_f1(tp, fp, fn) * sup), F.sum(sup)).alias(out))
    else:
        raise ValueError(f"unknown average {average!r}")
    return res


def matthews(df: DataFrame, pred: str, gold: str, by=None, weight: str | None = None) -> DataFrame:
    """M7: multiclass Matthews correlation from the confusion table; 0 when the denominator is 0."""
    by = as_list(by)
    cc = class_counts(confusion(df, pred, gold, by, weight), by)
    # predicted count of class k = tp + fp; true count = support
    agg = cc.groupBy(*by).agg(F.sum("tp").alias("c"), F.sum("support").alias("s"),
                              F.sum((F.col("tp") + F.col("fp")) * F.col("support")).alias("pt"),
                              F.sum((F.col("tp") + F.col("fp")) ** 2).alias("pp"),
                              F.sum(F.col("support") ** 2).alias("tt"))
    den = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    return agg.select(*by, safe_ratio(F.col("c") * F.col("s") - F.col("pt"), den).alias("mcc"))


def multilabel_counts(df: DataFrame, pred: str, gold: str, by=None) -> DataFrame:
    """Global tp/fp/fn of label sets (arrays), per key; no explode needed."""
    by = as_list(by)
    p, g = F.array_distinct(F.col(pred)), F.array_distinct(F.col(gold))
    tp = F.size(F.array_intersect(p, g))
    return df.groupBy(*by).agg(F.sum(tp).cast("double").alias("tp"),
                               F.sum(F.size(p) - tp).cast("double").alias("fp"),
                               F.sum(F.size(g) - tp).cast("double").alias("fn"))


def f1_micro_multilabel(df: DataFrame, pred: str, gold: str, by=None) -> DataFrame:
    """M6: micro F1 over label sets."""
    by = as_list(by)
    c = multilabel_counts(df, pred, gold, by)
    return c.select(*by, _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1_micro"))


def pearson(df: DataFrame, x: str, y: str, by=None, name: str = "pearson") -> DataFrame:
    """M8: Pearson r from one-pass central moments. NaN on constant input (as SciPy), never an ANSI error."""
    by = as_list(by)
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    both = F.when(X.isNotNull() & Y.isNotNull(), F.lit(1))
    Xb, Yb = F.when(both == 1, X), F.when(both == 1, Y)
    agg = df.groupBy(*by).agg(F.covar_pop(Xb, Yb).alias("cxy"), F.var_pop(Xb).alias("vx"), F.var_pop(Yb).alias("vy"))
    den = F.sqrt(F.col("vx") * F.col("vy"))
    return agg.select(*by, F.when(den == 0, F.lit(float("nan"))).otherwise(F.col("cxy") / den).alias(name))


def spearman(df: DataFrame, x: str, y: str, by=None, name: str = "spearman") -> DataFrame:
    """M9: Spearman rho = Pearson of average ranks (ties share the mean rank)."""
    by = as_list(by)
    ranked = average_ranks(df, x, by, "_rx")
    ranked = average_ranks(ranked, y, by, "_ry")
    return pearson(ranked, "_rx", "_ry", by, name)


def _outputs(df: DataFrame, pred: str, gold: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., _out, _err): squared error of every output; a single output is number 0."""
    if dict(df.dtypes)[pred].startswith("array"):
        both = F.arrays_zip(F.col(pred).alias("p"), F.col(gold).alias("g"))
        x = df.select(*keep, F.posexplode_outer(both).alias("_out", "_z")).filter(F.col("_out").isNotNull())
        return x.select(*keep, "_out", ((F.col("_z.p").cast("double") - F.col("_z.g").cast("double")) ** 2).alias("_err"))
    return df.select(*keep, F.lit(0).alias("_out"), ((F.col(pred).cast("double") - F.col(gold).cast("double")) ** 2).alias("_err"))


def mse(df: DataFrame, pred: str, gold: str, by=None, weight: str | None = None, squared: bool = True,
        name: str | None = None, multioutput: str = "uniform_average") -> DataFrame:
    """(weighted) mean squared error; ``squared=False`` gives RMSE.

    Array columns are several outputs: errors are averaged (and the root taken) per output, then over outputs;
    ``multioutput="raw_values"`` gives a row per output (column ``output``).
    """
    if multioutput not in ("uniform_average", "raw_values"):
        raise ValueError(f"multioutput must be uniform_average or raw_values, not {multioutput!r}")
    by = as_list(by)
    out = name or ("mse" if squared else "rmse")
    x = _outputs(df, pred, gold, [*by, *([weight] if weight else [])])
    w = _w(weight)
    val = safe_ratio(F.sum(w * F.col("_err")), F.sum(w))
    if not dict(df.dtypes)[pred].startswith("array") and multioutput == "uniform_average":
        return x.groupBy(*by).agg((val if squared else F.sqrt(val)).alias(out))
    each = x.groupBy(*by, F.col("_out").alias("output")).agg((val if squared else F.sqrt(val)).alias(out))
    return each if multioutput == "raw_values" else each.groupBy(*by).agg(F.avg(out).alias(out))


def regression_metrics(df: DataFrame, pred: str, gold: str, by=None, weight: str | None = None) -> DataFrame:
    """M10 + M2 in one scan: mse, rmse and, with a weight column, their weighted forms (outputs of arrays averaged)."""
    by = as_list(by)
    x = _outputs(df, pred, gold, [*by, *([weight] if weight else [])])
    names = ["mse"] + (["mse_weighted"] if weight else [])
    aggs = [F.avg("_err").alias("mse")]
    if weight:
        w = _w(weight)
        aggs.append(safe_ratio(F.sum(w * F.col("_err")), F.sum(w)).alias("mse_weighted"))
    if not dict(df.dtypes)[pred].startswith("array"):
        return x.groupBy(*by).agg(*aggs).select(*by, *names, *(F.sqrt(n).alias(n.replace("mse", "rmse")) for n in names))
    each = x.groupBy(*by, "_out").agg(*aggs)
    return each.groupBy(*by).agg(*(F.avg(n).alias(n) for n in names), *(F.avg(F.sqrt(n)).alias(n.replace("mse", "rmse")) for n in names))


def class_metrics(df: DataFrame, pred: str, gold: str, by=None, weight: str | None = None,
                  pos_label=1) -> DataFrame:
    """M1, M4, M5, M7 from one confusion table: accuracy, f1 (binary), f1_micro/macro/weighted, mcc."""
    by = as_list(by)
    conf = confusion(df, pred, gold, by, weight)
    cc = class_counts(conf, by)
    tp, fp, fn, sup = (F.col(c) for c in ("tp", "fp", "fn", "support"))
    pcnt = tp + fp
    agg = cc.groupBy(*by).agg(
        F.sum(tp).alias("c"), F.sum(sup).alias("s"), F.sum(fp).alias("sfp"), F.sum(fn).alias("sfn"),
        F.sum(F.when(F.col("label") == F.lit(pos_label), _f1(tp, fp, fn)).otherwise(0.0)).alias("f1"),
        F.avg(_f1(tp, fp, fn)).alias("f1_macro"),
        safe_ratio(F.sum(_f1(tp, fp, fn) * sup), F.sum(sup)).alias("f1_weighted"),
        F.sum(pcnt * sup).alias("pt"), F.sum(pcnt * pcnt).alias("pp"), F.sum(sup * sup).alias("tt"))
    c, s = F.col("c"), F.col("s")
    den = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    return agg.select(*by, safe_ratio(c, s).alias("accuracy"), "f1",
                      _f1(c, F.col("sfp"), F.col("sfn")).alias("f1_micro"), "f1_macro", "f1_weighted",
                      safe_ratio(c * s - F.col("pt"), den).alias("mcc"))


def combined_score(df: DataFrame, metrics: Sequence[str], name: str = "combined_score") -> DataFrame:
    """Mean of several metric columns, added only when there is more than one."""
    metrics = list(metrics)
    if len(metrics) < 2:
        return df
    return df.withColumn(name, sum((F.col(m) for m in metrics), F.lit(0.0)) / len(metrics))
