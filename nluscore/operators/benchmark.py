"""Benchmark reports from a specification (G1-G6, J11, S13, S15): which tasks, configs and metrics a suite has, what counts,
and what is missing.

A specification is a list of tasks: its metrics (the first one is reported), the factor that makes scores percent, and its
configs with their languages. It is a definition, not data: a few hundred entries, given as a parameter, that
every model found in the results is held against; an entry without a result counts 0 and is listed as missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Task(NamedTuple):
    name: str
    metrics: tuple[str, ...]
    factor: float = 100.0
    configs: tuple[tuple[str, str], ...] = (("", ""),)  # (config, language)


def languages(codes: str, pattern: str = "{}") -> tuple[tuple[str, str], ...]:
    """Configs of the languages in a comma list, named by a pattern."""
    return tuple((pattern.format(c), c) for c in codes.split(","))


# fixed values: GLUE tasks with the metric that is averaged
GLUE = (Task("cola", ("matthews_correlation",)), Task("sst2", ("accuracy",)), Task("mrpc", ("f1",)), Task("stsb", ("spearmanr",)),
        Task("qqp", ("f1",)), Task("mnli", ("accuracy",)), Task("qnli", ("accuracy",)), Task("rte", ("accuracy",)))

# fixed values: multilingual tasks with metrics, factor and languages (suites with other tasks pass their own)
MULTILINGUAL = (
    Task("xnli", ("accuracy",), 100.0, languages("ar,bg,de,el,en,es,fr,hi,ru,sw,th,tr,ur,vi,zh")),
    Task("paws-x", ("accuracy",), 100.0, languages("de,en,es,fr,ja,ko,zh")),
    Task("xquad", ("f1", "exact_match"), 1.0, languages("ar,de,el,en,es,ru,th,tr,vi,zh,ro", "xquad.{}")),
    Task("mlqa", ("f1", "exact_match"), 1.0, languages("ar,de,en,es,hi,vi,zh", "mlqa.{0}.{0}")),
    Task("tydiqa", ("f1", "exact_match"), 1.0, languages("en,ar,bn,fi,id,ko,ru,sw,te")),
    Task("bucc18", ("f1",), 100.0, languages("de,fr,ru,zh", "bucc18.{}")),
    Task("xcopa", ("accuracy",), 100.0, languages("et,ht,id,it,qu,sw,ta,th,tr,vi,zh")),
    Task("mewslix", ("map_at_20",), 100.0, languages("ar,de,en,es,fa,ja,pl,ro,ta,tr,uk")),
    Task("lareqa", ("map_at_20",), 100.0, languages("ar,de,el,en,es,hi,ru,th,tr,vi,zh")),
)
SUITES = {"first": ("xnli", "paws-x", "xquad", "mlqa", "tydiqa", "bucc18"), "revised": ("xnli", "xcopa", "xquad", "mlqa", "tydiqa", "mewslix", "lareqa")}


def spec_rows(tasks: Sequence[Task]) -> Column:
    """The specification as an array of structs (task, config, lang, metric, metric_rank, factor)."""
    return F.array(*(F.struct(F.lit(t.name).alias("task"), F.lit(c).alias("config"), F.lit(lang).alias("lang"), F.lit(m).alias("metric"),
                              F.lit(k).alias("metric_rank"), F.lit(float(t.factor)).alias("factor"))
                     for t in tasks for c, lang in t.configs for k, m in enumerate(t.metrics)))


def held_against(results: DataFrame, tasks: Sequence[Task], marker: str | None = None) -> DataFrame:
    """One row per model and entry of the specification, with ``value`` (null: missing).

    ``results``: model, task, config, metric, value. Models are those with any result, with ``marker`` those that have a
    result of that task; results outside any model folder (an empty model name) count as one model of their own (S15).
    A result that is there more than once counts with its greatest value.
    """
    name = F.when(F.col("model").isNull(), "").otherwise(F.col("model"))
    r = results.select(name.alias("model"), "task", F.coalesce("config", F.lit("")).alias("config"), "metric", "value")
    models = (r.filter(F.col("task") == marker) if marker else r).select("model").distinct()
    wanted = models.select("model", F.inline(spec_rows(tasks)))
    best = r.groupBy("model", "task", "config", "metric").agg(F.max("value").alias("value"))
    return wanted.join(best, ["model", "task", "config", "metric"], "left")


def missing(held: DataFrame) -> DataFrame:
    """Entries of the specification that a model has no result for."""
    return held.filter(F.col("value").isNull()).select("model", "task", "config", "metric")


def task_scores(held: DataFrame) -> DataFrame:
    """G1: per model, task and metric, the mean over the task's configs x factor; a missing config counts 0."""
    score = F.avg(F.coalesce("value", F.lit(0.0)) * F.col("factor"))
    return held.groupBy("model", "task", "metric", "metric_rank").agg(score.alias("value"))


def suite_scores(scores: DataFrame, suites: dict[str, Sequence[str]]) -> DataFrame:
    """Per model and suite, the mean of its tasks' first metrics."""
    member = F.array(*(F.struct(F.lit(s).alias("suite"), F.lit(t).alias("member")) for s, ts in suites.items() for t in ts))
    x = scores.filter("metric_rank = 0").select("model", "task", "value", F.inline(member)).filter(F.col("task") == F.col("member"))
    return x.groupBy("model", "suite").agg(F.avg("value").alias("value"))


def language_scores(held: DataFrame) -> DataFrame:
    """Per model and language, the mean over the tasks that have it of their first metric x factor."""
    x = held.filter("metric_rank = 0").withColumn("score", F.coalesce("value", F.lit(0.0)) * F.col("factor"))
    return x.groupBy("model", "lang").agg(F.avg("score").alias("value"))


def details(held: DataFrame) -> DataFrame:
    """G5, long: per model, task and language the first metric x factor."""
    return held.filter("metric_rank = 0").select("model", "task", "lang", (F.coalesce("value", F.lit(0.0)) * F.col("factor")).alias("value"))


def report(held: DataFrame, suites: dict[str, Sequence[str]]) -> DataFrame:
    """All parts as (model, section, name, value): task-metric, suite, language, task.language, and the number of missing entries."""
    scores = task_scores(held)
    parts = [scores.select("model", F.lit("task").alias("section"), F.concat_ws("-", "task", "metric").alias("name"), "value"),
             suite_scores(scores, suites).select("model", F.lit("suite").alias("section"), F.col("suite").alias("name"), "value"),
             language_scores(held).select("model", F.lit("lang").alias("section"), F.col("lang").alias("name"), "value"),
             details(held).select("model", F.lit("detail").alias("section"), F.concat_ws(".", "task", "lang").alias("name"), "value"),
             missing(held).groupBy("model", "task").agg(F.count(F.lit(1)).cast("double").alias("value"))
             .select("model", F.lit("missing").alias("section"), F.col("task").alias("name"), "value")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wide_table(scores: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """A row per model: ``avg`` of the tasks' first metrics, then a column per task, in the order of the specification."""
    names = [t.name for t in tasks]
    x = scores.filter("metric_rank = 0").groupBy("model").pivot("task", names).agg(F.first("value"))
    total = F.lit(0.0)
    for n in names:
        total = total + F.coalesce(F.col(f"`{n}`"), F.lit(0.0))
    return x.select("model", (total / len(names)).alias("avg"), *(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names))
