"""Roll-ups of long metrics tables into task, language and suite reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics_table import as_list


def macro_average(long_df: DataFrame, by, config_col: str = "config", label: str = "avg",
                  require_all: bool = False) -> DataFrame:
    """G1: mean of each metric over configs, emitted as config ``label``.

    ``require_all``: emit a metric only if every config of the key has it (classification rule).
    """
    by = as_list(by)
    agg = long_df.groupBy(*by, "metric").agg(F.avg("value").alias("value"),
                                             F.countDistinct(config_col).alias("_n"))
    if require_all:
        total = long_df.groupBy(*by).agg(F.countDistinct(config_col).alias("_all"))
        keys = by or ["_k"]
        if not by:
            agg, total = agg.withColumn("_k", F.lit(0)), total.withColumn("_k", F.lit(0))
        agg = agg.join(total, keys, "inner").drop("_k")
        agg = agg.filter(F.col("_n") == F.col("_all")).drop("_all")
    return agg.select(*by, F.lit(label).alias(config_col), "metric", F.round("value", 6).alias("value"))


def fill_spec(spec: DataFrame, results: DataFrame, keys, value: str = "value") -> DataFrame:
    """Every (task, config, metric) the spec asks for, from the results; missing → 0.

    The spec is a small table (suite definition); it drives the join so that absent results still
    produce a row.
    """
    keys = as_list(keys)
    r = results.select(*keys, F.col(value).alias("_v"))
    return spec.join(r, keys, "left").withColumn(
        value, F.coalesce(F.col("_v"), F.lit(0.0))).drop("_v")


def _scaled(filled: DataFrame, factor: float):
    """Value × the row's own ``factor`` where the spec has that column (scores already in percent: 1)."""
    own = F.coalesce(F.col("factor"), F.lit(factor)) if "factor" in filled.columns else F.lit(factor)
    return F.col("value") * own


def task_scores(filled: DataFrame, model: str = "model", factor: float = 100.0) -> DataFrame:
    """Per model and task, the mean over its configs of the task's first metric × factor (the spec's own, if it has one)."""
    first = filled.filter(F.col("metric_rank") == 0)
    return first.groupBy(model, "task").agg(F.avg(_scaled(filled, factor)).alias("value"))


def suite_scores(tasks: DataFrame, suites: DataFrame, model: str = "model") -> DataFrame:
    """Suite averages over listed tasks (suites: suite, task)."""
    j = tasks.join(suites, "task", "inner")
    return j.groupBy(model, "suite").agg(F.avg("value").alias("value"))


def language_scores(filled: DataFrame, model: str = "model", factor: float = 100.0) -> DataFrame:
    """Per model and language, mean over tasks of the first metric × factor (R13: union of
    languages, a language no task has stays absent rather than dividing by zero)."""
    first = filled.filter(F.col("metric_rank") == 0)
    return first.groupBy(model, "lang").agg(F.avg(_scaled(filled, factor)).alias("value"))


def language_detail(filled: DataFrame, model: str = "model", factor: float = 100.0) -> DataFrame:
    """Per task a row per model with one column per language (first metric × factor)."""
    first = filled.filter(F.col("metric_rank") == 0)
    return first.groupBy(model, "task").pivot("lang").agg(F.first(_scaled(filled, factor)))


def config_language(spec_rows: list[tuple[str, str, str]], spark) -> DataFrame:
    """(task, config, lang) spec table from a list literal."""
    return spark.createDataFrame(spec_rows, "task string, config string, lang string")
