"""Metric bundles per task and user hooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import classify as C
from .metrics_table import as_list, to_long

# fixed values: GLUE task → metric bundle
GLUE_BUNDLES = {
    "cola": ("mcc",),
    "stsb": ("pearson", "spearman"),
    "mrpc": ("accuracy", "f1"),
    "qqp": ("accuracy", "f1"),
    "sst2": ("accuracy",),
    "mnli": ("accuracy",),
    "mnli_mismatched": ("accuracy",),
    "mnli_matched": ("accuracy",),
    "qnli": ("accuracy",),
    "rte": ("accuracy",),
    "wnli": ("accuracy",),
    "hans": ("accuracy",),
}


# fixed values: names under which reports look metrics up
REPORT_NAMES = {"mcc": "matthews_correlation", "spearman": "spearmanr"}


def report_names(long_df: DataFrame) -> DataFrame:
    """Metric names as the roll-ups of benchmark reports ask for them."""
    name = F.col("metric")
    for short, full in REPORT_NAMES.items():
        name = F.when(F.col("metric") == short, full).otherwise(name)
    return long_df.withColumn("metric", name)


def glue_metrics(df: DataFrame, task: str, pred: str = "pred", gold: str = "label", by=None) -> DataFrame:
    """The task's metric bundle as a long table; unknown task is an error."""
    by = as_list(by)
    if task not in GLUE_BUNDLES:
        raise KeyError(f"unknown task {task!r}; expected one of {sorted(GLUE_BUNDLES)}")
    names = GLUE_BUNDLES[task]
    if task == "stsb":
        wide = C.pearson(df, pred, gold, by)
        s = C.spearman(df, pred, gold, by)
        wide = wide.join(s, by) if by else wide.withColumn("_k", F.lit(0)).join(s.withColumn("_k", F.lit(0)), "_k").drop("_k")
    else:
        wide = C.class_metrics(df, pred, gold, by)
        wide = wide.select(*by, *names)
    wide = C.combined_score(wide, names)
    return to_long(wide, by)


def pick_metric(problem_type: str, name: str | None = None) -> str:
    """Default metric per problem type, overridable by name (mse, accuracy, f1)."""
    if name is not None:
        if name not in ("mse", "accuracy", "f1"):
            raise ValueError(f"metric {name!r} not in mse, accuracy, f1")
        return name
    return {"regression": "mse", "multi_label_classification": "f1"}.get(problem_type, "accuracy")


def problem_metrics(df: DataFrame, problem_type: str, pred: str, gold: str, by=None, name: str | None = None) -> DataFrame:
    """M14 applied: regression → mse on squeezed predictions; multi-label → micro F1 on logits > 0;
    single-label → accuracy of the argmax."""
    from ..functions.text import argmax, squeeze, threshold_multihot
    m = pick_metric(problem_type, name)
    ptype = dict(df.dtypes)[pred]
    if problem_type == "regression":
        x = df.withColumn("_p", squeeze(pred) if ptype.startswith("array") else F.col(pred))
        wide = C.mse(x, "_p", gold, by)
    elif problem_type == "multi_label_classification":
        x = df.withColumn("_p", threshold_multihot(pred))
        ids = lambda c: F.filter(F.transform(c, lambda v, i: F.when(v > 0, i)), lambda v: v.isNotNull())
        x = x.withColumn("_pi", ids(F.col("_p"))).withColumn("_gi", ids(F.col(gold)))
        wide = C.f1_micro_multilabel(x, "_pi", "_gi", by).withColumnRenamed("f1_micro", "f1")
    else:
        x = df.withColumn("_p", argmax(pred) if ptype.startswith("array") else F.col(pred))
        wide = C.class_metrics(x, "_p", gold, by)
        if m == "f1":
            # decision R16, per key: binary F1 where it has at most two classes, macro F1 where it has more
            keys = as_list(by)
            classes = C.class_counts(C.confusion(x, "_p", gold, keys), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_classes"))
            if keys:
                classes = classes.withColumnsRenamed({k: f"_c_{k}" for k in keys})
                wide = wide.join(classes, [wide[k].eqNullSafe(classes[f"_c_{k}"]) for k in keys])
            else:
                wide = wide.withColumn("_one", F.lit(0)).join(classes.withColumn("_one", F.lit(0)), "_one")
            wide = wide.withColumn("f1", F.when(F.col("_classes") <= 2, F.col("f1")).otherwise(F.col("f1_macro")))
        wide = wide.select(*as_list(by), m)
    return to_long(wide, by)


def merge_matched(matched: DataFrame, mismatched: DataFrame) -> DataFrame:
    """Mismatched metrics renamed with ``_mm`` and merged with the matched ones."""
    return matched.unionByName(mismatched.withColumn("metric", F.concat(F.col("metric"), F.lit("_mm"))))


def sample_counts(df: DataFrame, name: str, limit: int | None = None, by=None) -> DataFrame:
    """``<name>_samples`` = min(limit, rows) per key."""
    by = as_list(by)
    n = F.count(F.lit(1))
    v = F.least(n, F.lit(limit)) if limit is not None else n
    return to_long(df.groupBy(*by).agg(v.alias(f"{name}_samples")), by)


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """user batch function (pandas DataFrame → pandas DataFrame, may change row count)."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def custom_metric(df: DataFrame, fn: Callable, schema, by=None) -> DataFrame:
    """user metric over the predictions/references of each key (grouped pandas function).

    Each key's rows go to one task: use it for per-key metrics whose groups are bounded; global
    metrics should be Column aggregates (see ``classify``).
    """
    by = as_list(by)
    if not by:
        raise ValueError("custom_metric needs a grouping key; global metrics belong in Column aggregates")
    return df.groupBy(*by).applyInPandas(fn, schema)


def custom_metric_states(df: DataFrame, init: Callable, update: Callable, merge: Callable, finish: Callable, schema, by=None,
                         columns=None, salts: int = 32, held: int = 4096) -> DataFrame:
    """F2 at any size: a user metric as a mergeable state, per ``by`` key or over all rows.

    ``init()`` makes a state, ``update(state, pandas frame)`` returns it with some rows of one key taken in,
    ``merge(a, b)`` joins two, ``finish(state)`` gives the metric columns (``schema``: their DDL) as a dict. States travel
    pickled. Every task keeps one state a key (passing on the oldest beyond ``held``), so a key of any size is shuffled as
    one small state per task; states are merged in two steps, first within ``salts`` parts of a key. ``columns``: what the
    frames hold besides the keys (default: all columns).
    """
    import pickle

    import pandas as pd
    import pyarrow as pa
    from pyspark import cloudpickle

    by = as_list(by)
    cols = list(columns) if columns is not None else [c for c in df.columns if c not in by]
    keys = [f"_k{i}" for i in range(len(by))]
    named = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), *cols)
    code = cloudpickle.dumps((init, update, merge, finish))
    kinds = [named.schema[k].dataType for k in keys]
    state_schema = ", ".join([*(f"{k} {t.simpleString()}" for k, t in zip(keys, kinds)), "_salt int", "_state binary"])
    types = [pa.null()] * len(keys)

    def partial(batches):
        start, take, _, _ = pickle.loads(code)
        states: dict = {}

        def rows(some: dict):
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k in some], types[i]) for i in range(len(keys))), pa.array([0] * len(some), pa.int32()),
                 pa.array([cloudpickle.dumps(s) for s in some.values()], pa.binary())], names=[*keys, "_salt", "_state"])

        for b in batches:
            types[:] = [b.schema.field(k).type for k in keys]
            frame = b.to_pandas()
            parts = [((), frame)] if not keys else ((k, part.drop(columns=keys)) for k, part in frame.groupby(keys, dropna=False, sort=False))
            for k, part in parts if len(frame) else []:
                k = tuple(None if pd.isna(x) else x for x in (k if isinstance(k, tuple) else (k,))) if keys else ()
                states[k] = take(states.pop(k) if k in states else start(), part)
            if len(states) > held:
                old = dict(list(states.items())[:len(states) - held])
                for k in old:
                    del states[k]
                yield rows(old)
        if states:
            yield rows(states)

    def merged(table: "pa.Table") -> "pa.Table":
        _, _, join, _ = pickle.loads(code)
        state = None
        for raw in table.column("_state"):
            one = pickle.loads(raw.as_py())
            state = one if state is None else join(state, one)
        first = table.slice(0, 1)
        return first.set_column(first.schema.get_field_index("_state"), "_state", pa.array([cloudpickle.dumps(state)], pa.binary()))

    # a task's number spreads its states over the salts
    states = named.mapInArrow(partial, state_schema).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int"))
    once = states.groupBy(*keys, "_salt").applyInArrow(merged, state_schema).withColumn("_salt", F.lit(0))
    last = once.groupBy(*keys, "_salt").applyInArrow(merged, state_schema)

    def done(batches):
        _, _, _, end = pickle.loads(code)
        for frame in batches:
            got = pd.DataFrame([end(pickle.loads(s)) for s in frame["_state"]])
            yield pd.concat([frame[keys].reset_index(drop=True), got], axis=1) if keys else got

    out = ", ".join([*(f"{k} {t.simpleString()}" for k, t in zip(keys, kinds)), schema])
    return last.mapInPandas(done, out).withColumnsRenamed(dict(zip(keys, by)))


def post_process(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """user step between model output and metric."""
    return df.transform(fn)
