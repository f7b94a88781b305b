"""The long metrics table ``(by..., metric, value)`` every scoring operator can emit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(by) -> list[str]:
    if by is None:
        return []
    if isinstance(by, str):
        return [by]
    return list(by)


def to_long(df: DataFrame, by: Sequence[str], metrics: Sequence[str] | None = None, digits: int | None = 6) -> DataFrame:
    """Unpivot wide metric columns into ``(by..., metric, value double)``."""
    by = as_list(by)
    metrics = list(metrics) if metrics is not None else [c for c in df.columns if c not in by]
    wide = df.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics])
    out = wide.unpivot(by, metrics, "metric", "value") if by else wide.unpivot([], metrics, "metric", "value")
    if digits is not None:
        out = out.withColumn("value", F.round("value", digits))
    return out


def safe_ratio(num: Column, den: Column, zero: float = 0.0) -> Column:
    """num / den with ``zero`` when den is 0 or null (no ANSI divide-by-zero error)."""
    return F.when(den.isNull() | (den == 0), F.lit(zero)).otherwise(num.cast("double") / den.cast("double"))


def prefix_metrics(long_df: DataFrame, prefix: str) -> DataFrame:
    """S12 key prefix (``eval_``/``predict_``/``test_``); names already prefixed are left alone."""
    p = prefix.rstrip("_") + "_"
    return long_df.withColumn(
        "metric", F.when(F.col("metric").startswith(p), F.col("metric")).otherwise(F.concat(F.lit(p), F.col("metric")))
    )
