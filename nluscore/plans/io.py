"""Fixture queries that round-trip the sinks through the shared scratch folder (S9, S10 + I1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import with_row_id
from ..session import scratch_path
from ..sources import sinks as K
from . import tokens as TK
from .tables import classification_input


def predictions_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 + S9: per language, dense 0-based index in doc_id order and the predicted label, written as
    ``index<TAB>prediction`` files per config and read back."""
    cls = classification_input(spark, sf_dir).select("config", "doc_id", "pred")
    idx = with_row_id(cls, ["doc_id"], "index", by="config")
    path = scratch_path(spark, "predictions")
    K.write_predictions(idx.select("config", "index", F.col("pred").alias("prediction")), path)
    back = spark.read.option("sep", "\t").option("header", True).schema(
        "index long, prediction string, config string").csv(path)
    return back.select("config", "index", "prediction")


def tags_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of space-separated gold tags per document, written per language and read back."""
    d = TK._tagged_docs(spark, sf_dir).select(F.col("lang").alias("config"), F.col("gold_tags").alias("tags"))
    path = scratch_path(spark, "tags")
    K.write_tags(d, path)
    return spark.read.text(path).select("config", F.col("value").alias("line"))


def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12 + S14: metrics of two tasks written to a results store partitioned by model/task and
    read back as one long table."""
    from ..sources.readers import read_results
    from . import classification
    acc = classification.accuracy_by_lang(spark, sf_dir).select(F.lit("quality").alias("task"), "config", "metric", "value")
    ent = TK.entity_report(spark, sf_dir).select(F.lit("entities").alias("task"), F.col("type").alias("config"),
                                                 "metric", "value")
    long = acc.unionByName(ent).withColumn("model", F.lit("fixture"))
    path = scratch_path(spark, "results")
    K.write_results(long, path)
    return read_results(spark, path, layout="long")
