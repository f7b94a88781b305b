"""Sources and the dataset catalog.

Task data lives in one Parquet dataset partitioned by ``dataset/config/split``: asking for a
config or split is a partition filter that Spark prunes at planning time.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ("dataset", "config", "split")
ALLOWED_EXT = ("csv", "json", "jsonl")


def read_task(spark: SparkSession, root: str, dataset: str | None = None, config: str | Sequence[str] | None = None,
              split: str | Sequence[str] | None = None) -> DataFrame:
    """Rows of one dataset (and configs/splits) from the partitioned task store."""
    df = spark.read.parquet(root)
    for col, val in (("dataset", dataset), ("config", config), ("split", split)):
        if val is None:
            continue
        vals = [val] if isinstance(val, str) else list(val)
        df = df.filter(F.col(col).isin(vals))
    return df


def validate_sources(files: Mapping[str, str]) -> str:
    """csv/json only, one extension for all splits, at least one file. Returns the format."""
    if not files:
        raise ValueError("need at least one data file (train, validation or test)")
    exts = {os.path.splitext(p.rstrip("/"))[1].lstrip(".").lower() for p in files.values()}
    if len(exts) != 1:
        raise ValueError(f"all splits must share one file type, got {sorted(exts)}")
    ext = exts.pop()
    if ext not in ALLOWED_EXT:
        raise ValueError(f"file type must be csv or json, got {ext!r}")
    return "json" if ext in ("json", "jsonl") else "csv"


def read_files(spark: SparkSession, files: Mapping[str, str], schema: T.StructType | str | None = None,
               multiline: bool = False) -> DataFrame:
    """CSV or JSON(L) files per split into one DataFrame with a ``split`` column."""
    fmt = validate_sources(files)
    out = None
    for split, path in files.items():
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        if fmt == "csv":
            df = r.option("header", True).option("multiLine", multiline).option("escape", '"').csv(path)
        else:
            df = r.option("multiLine", multiline).json(path)
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_nested(spark: SparkSession, path: str, field: str = "data", schema: T.StructType | None = None) -> DataFrame:
    """JSON documents holding the records as a list under ``field``."""
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(T.StructType([T.StructField(field, T.ArrayType(schema))]))
    return r.json(path).select(F.inline(F.col(field)))


def list_configs(df: DataFrame, which: str | Sequence[str] | None = None, default: str | None = None) -> list[str]:
    """Configs to evaluate: ``all_config`` (every distinct config), a comma list, or the default.
    R15: duplicates are dropped, order kept."""
    if which is None:
        return [default] if default else []
    if isinstance(which, str) and which == "all_config":
        return sorted(r[0] for r in df.select("config").distinct().collect())
    items = which.split(",") if isinstance(which, str) else list(which)
    seen: list[str] = []
    for c in (x.strip() for x in items):
        if c and c not in seen:
            seen.append(c)
    return seen


def ingest(catalog: Sequence[Mapping[str, str]], spark: SparkSession, root: str,
           schema: T.StructType | str | None = None) -> None:
    """Read each catalog entry ``{dataset, config, split, path}`` and append it to the task store
    partitioned by dataset/config/split (the catalog is a short list of sources)."""
    for entry in catalog:
        src = entry["path"]
        fmt = validate_sources({entry["split"]: src})
        r = spark.read if schema is None else spark.read.schema(schema)
        df = r.option("header", True).csv(src) if fmt == "csv" else r.json(src)
        (df.withColumn("dataset", F.lit(entry["dataset"])).withColumn("config", F.lit(entry["config"]))
           .withColumn("split", F.lit(entry["split"]))
           .write.mode("append").partitionBy(*PARTITIONS).parquet(root))


def read_corpus(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """An external retrieval corpus as ``(docid, text)``."""
    return df.select(F.col(id_col).alias("docid"), F.col(text_col).alias("text"))


RESULT_FILE = r"^.*/([^/]+)/([^/]+)/all_results\.json$"
TASK_FILE = r"^.*/([^/]+)/([^/]+)\.json$"


def read_results(spark: SparkSession, root: str, layout: str = "objects") -> DataFrame:
    """Metric files of every model under ``root`` → long ``(model, task, config, metric, value)``.

    ``objects``: one JSON object per file; ``<model>/<task>/all_results.json`` wins over
    ``<model>/<task>.json``; top-level numbers get config ``''``; the ``all_metrics`` object gives one
    config per key. ``long``: the partitioned store written by ``sinks.write_results``.
    """
    if layout == "long":
        return spark.read.schema("config string, metric string, value double, model string, task string").json(
            root).select("model", "task", "config", "metric", "value")
    files = (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.json").text(root)
             .withColumn("path", F.input_file_name()))
    nested = F.regexp_extract("path", RESULT_FILE, 1) != ""
    files = files.select(
        F.when(nested, F.regexp_extract("path", RESULT_FILE, 1)).otherwise(F.regexp_extract("path", TASK_FILE, 1)).alias("model"),
        F.when(nested, F.regexp_extract("path", RESULT_FILE, 2)).otherwise(F.regexp_extract("path", TASK_FILE, 2)).alias("task"),
        F.when(nested, 0).otherwise(1).alias("priority"), "value")
    w = Window.partitionBy("model", "task").orderBy("priority")
    files = files.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", "priority")
    top = files.select("model", "task", F.explode(F.from_json("value", "map<string,string>")).alias("metric", "raw"))
    flat = top.filter(F.col("metric") != "all_metrics").select(
        "model", "task", F.lit("").alias("config"), "metric", F.expr("try_cast(raw AS double)").alias("value"))
    per = files.select("model", "task", F.explode(F.from_json(F.get_json_object("value", "$.all_metrics"),
                                                              "map<string,map<string,double>>")).alias("config", "m"))
    per = per.select("model", "task", "config", F.explode("m").alias("metric", "value"))
    return flat.filter(F.col("value").isNotNull()).unionByName(per)


def compact_results(spark: SparkSession, root: str, out: str) -> None:
    """Consolidate many small result files into one partitioned Parquet table (no deletes)."""
    read_results(spark, root).write.mode("overwrite").partitionBy("model").parquet(out)


def discover_models(results: DataFrame, probe_task: str) -> DataFrame:
    """Models whose results include ``probe_task``."""
    return results.filter(F.col("task") == probe_task).select("model").distinct()
