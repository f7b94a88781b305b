"""Fixture query for the suite report: long metrics of other fixture queries → task, suite,
language and detail scores (J11, G1-G6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import benchmark as B
from ..operators import report as G
from ..session import cut_lineage
from . import classification, tokens
from .tables import load

# fixed values: the fixture suite definition (task → metrics, first one reported) and its languages
TASKS = {"quality": ["accuracy"], "quality_pair": ["f1", "accuracy"], "entities": ["f1", "precision", "recall"]}
LANGS = ["de", "en", "es", "fr", "sw"]
SUITES = {"suite_a": ["quality", "quality_pair"], "suite_b": ["quality_pair", "entities"]}
MODEL = "fixture"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = classification.accuracy_by_lang(spark, sf_dir).filter(F.col("config") != "avg").select(
        F.lit("quality").alias("task"), "config", "metric", "value")
    pair = classification.f1_mcc_by_lang(spark, sf_dir).select(F.lit("quality_pair").alias("task"), "config", "metric", "value")
    ent = tokens.entity_report(spark, sf_dir).filter(F.col("type") != "overall").select(
        F.lit("entities").alias("task"), F.col("type").alias("config"), "metric", "value")
    return acc.unionByName(pair).unionByName(ent).withColumn("model", F.lit(MODEL))


def suite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (model, section, name, value): per task, per suite, per language, per task.language."""
    spec = spark.createDataFrame(
        [(MODEL, t, lang, lang, m, i) for t, ms in TASKS.items() for lang in LANGS for i, m in enumerate(ms)],
        "model string, task string, config string, lang string, metric string, metric_rank int")
    suites = spark.createDataFrame([(s, t) for s, ts in SUITES.items() for t in ts], "suite string, task string")
    # the filled table is spec-sized; cut its lineage once so the four parts below do not each
    # recompute the three source queries
    filled = cut_lineage(G.fill_spec(spec, _results(spark, sf_dir), ["model", "task", "config", "metric"]))
    tasks = G.task_scores(filled)
    parts = [
        tasks.select("model", F.lit("task").alias("section"), F.col("task").alias("name"), "value"),
        G.suite_scores(tasks, suites).select("model", F.lit("suite").alias("section"), F.col("suite").alias("name"), "value"),
        G.language_scores(filled).select("model", F.lit("lang").alias("section"), F.col("lang").alias("name"), "value"),
        filled.filter(F.col("metric_rank") == 0).select(
            "model", F.lit("detail").alias("section"), F.concat_ws(".", "task", "lang").alias("name"),
            (F.col("value") * 100.0).alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", F.round("value", 6))


def _measured(spark: SparkSession, sf_dir: str, tasks, models: int) -> DataFrame:
    """Results of several models as event values: the entry number ``event_id mod n`` of the specification, the model of the
    user. The last model has no result for the first task's first config, and the model's name is empty for one."""
    entries = [(k, t.name, c, m) for k, (t, c, m) in enumerate((t, c, m) for t in tasks for c, _ in t.configs for m in t.metrics)]
    spec = spark.createDataFrame(entries, "entry int, task string, config string, metric string")
    ev = load(spark, sf_dir, "events").select(F.pmod("event_id", F.lit(len(entries))).cast("int").alias("entry"),
                                              F.pmod("user_id", F.lit(models)).cast("int").alias("m"), "value")
    means = ev.groupBy("entry", "m").agg(F.avg("value").alias("value")).filter((F.col("entry") > 0) | (F.col("m") < models - 1))
    model = F.when(F.col("m") == 0, "").otherwise(F.concat(F.lit("model"), F.col("m").cast("string")))
    return means.join(spec, "entry").select(model.alias("model"), "task", "config", "metric", (F.col("value") / 100.0).alias("value"))


def glue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model, the average and a column per GLUE task."""
    held = B.held_against(_measured(spark, sf_dir, B.GLUE, 4), B.GLUE, marker="mnli")
    wide = B.wide_table(B.task_scores(held), B.GLUE)
    return wide.select("model", *(F.round(c, 6).alias(c) for c in wide.columns if c != "model"))


def multilingual_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with all their metrics, two suites, languages, details and missing entries of three models."""
    held = cut_lineage(B.held_against(_measured(spark, sf_dir, B.MULTILINGUAL, 3), B.MULTILINGUAL, marker="mlqa"))
    return B.report(held, B.SUITES).withColumn("value", F.round("value", 6))
