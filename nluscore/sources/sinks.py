"""Sinks (S9-S13): prediction files, tag files, QA outputs, metrics and reports.

All writers are partitioned Spark writes (one folder per config), never a driver-side loop and
never funnelled through a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics_table import as_list, prefix_metrics


def write_predictions(df: DataFrame, path: str, index: str = "index", prediction: str = "prediction",
                      kind: str = "label", by=("config",), mode: str = "overwrite") -> None:
    """``index<TAB>prediction`` per config; regression values as ``%3.3f`` (Java rounds half up on
    the decimal form, Python on the binary value: compare such files by parsed value)."""
    by = as_list(by)
    p = F.format_string("%3.3f", F.col(prediction).cast("double")) if kind == "regression" else F.col(prediction).cast("string")
    (df.select(*by, F.col(index).cast("long").alias("index"), p.alias("prediction"))
       .write.mode(mode).partitionBy(*by).option("sep", "\t").option("header", True).csv(path))


def write_tags(df: DataFrame, path: str, tags: str = "tags", by=("config",), order: str | None = None,
               mode: str = "overwrite", index: str | None = None) -> None:
    """One sentence per line, tags separated by spaces; with ``index`` the sentence's number and a tab stand before them, so
    that a reader can put lines of parallel files in order."""
    by = as_list(by)
    x = df.sortWithinPartitions(order) if order else df
    line = F.array_join(F.col(tags), " ")
    if index:
        line = F.concat(F.col(index).cast("string"), F.lit("\t"), line)
    x.select(*by, line.alias("value")).write.mode(mode).partitionBy(*by).text(path)


def write_qa_outputs(answers: DataFrame, nbest: DataFrame, path: str, null_odds: DataFrame | None = None,
                     prefix: str = "eval", by=("config",), mode: str = "overwrite") -> None:
    """Answers, n-best lists (array of structs per id) and null odds, keyed by id."""
    by = as_list(by)
    answers.write.mode(mode).partitionBy(*by).json(f"{path}/{prefix}_predictions")
    nb = nbest.groupBy(*by, "example_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "probability", "start_logit", "end_logit"))),
                    lambda s: s.dropFields("rank")).alias("nbest"))
    nb.write.mode(mode).partitionBy(*by).json(f"{path}/{prefix}_nbest_predictions")
    if null_odds is not None:
        null_odds.write.mode(mode).partitionBy(*by).json(f"{path}/{prefix}_null_odds")


def write_metrics(long_df: DataFrame, path: str, prefix: str | None = "eval", stamp: dict | None = None,
                  mode: str = "overwrite") -> None:
    """Long metrics with a key prefix and config/language stamps → JSON."""
    x = prefix_metrics(long_df, prefix) if prefix else long_df
    for k, v in (stamp or {}).items():
        x = x.withColumn(k, F.lit(v))
    x.write.mode(mode).json(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report table as CSV with header (a folder of part files, written in parallel)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_results(long_df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """S12 for a results store: long metrics ``(model, task, config, metric, value)`` as JSON lines
    partitioned by model and task (read back with ``read_results(..., layout="long")``)."""
    long_df.select("model", "task", "config", "metric", "value").write.mode(mode).partitionBy(
        "model", "task").json(root)
