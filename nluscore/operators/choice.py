"""Multiple choice (C1-C3): wide → long choices, regroup, pick the best choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import choice_templates, fill_template
from .metrics_table import as_list


def explode_choices(df: DataFrame, ids, endings: Sequence[str], template: str = "{question} {ending}",
                    mapping: dict | None = None) -> DataFrame:
    """C1 + P11: one row per (example, choice) with the filled input text; no shuffle (Generate)."""
    ids = as_list(ids)
    m = dict(mapping or {})
    m["ending"] = "_ending"
    keep = [c for c in df.columns if c not in endings]
    long = df.select(*keep, F.posexplode(F.array(*[F.col(e).cast("string") for e in endings])).alias("choice", "_ending"))
    return long.withColumn("input_text", fill_template(template, m)).withColumnRenamed("_ending", "ending")


def explode_choice_pairs(df: DataFrame, ids, endings: Sequence[str], question_in_first: bool = False, first: str | None = None,
                         second: str | None = None, mapping: dict | None = None) -> DataFrame:
    """C1 + P11: one row per (example, choice) with two input texts, ``first_text`` and ``second_text``, from the templates of
    :func:`choice_templates`; a template may use the fields context, question and ending in any way."""
    one, two = choice_templates(question_in_first, first, second)
    long = explode_choices(df, ids, endings, one, mapping).withColumnRenamed("input_text", "first_text")
    return long.withColumn("second_text", fill_template(two, dict(mapping or {})))


def regroup_choices(scores: DataFrame, ids, score: str = "score") -> DataFrame:
    """N choices per example back into one array in choice order."""
    ids = as_list(ids)
    return scores.groupBy(*ids).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("choice", score))), lambda s: s[score]).alias("scores"))


def best_choice(scores: DataFrame, ids, score: str = "score") -> DataFrame:
    """Predicted choice = first maximum of the scores (argmax), partial aggregation per example."""
    ids = as_list(ids)
    return scores.groupBy(*ids).agg(F.max_by("choice", F.struct(F.col(score), -F.col("choice"))).alias("pred"))
