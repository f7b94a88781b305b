"""Reading the fixture tables and deriving model-output stand-ins from them (FIXTURES.md §C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def classification_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gold = labels.quality, pred = n_chars >= 200, config = lang, weight = toxic + 1."""
    labels = load(spark, sf_dir, "labels")
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return labels.join(docs, "doc_id", "inner").select(
        "doc_id",
        F.col("lang").alias("config"),
        F.col("quality").alias("gold"),
        (F.col("n_chars") >= 200).cast("int").alias("pred"),
        (F.col("toxic") + 1).alias("weight"),
    )


def regression_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pred = l_quantity * 1500, gold = l_extendedprice, weight = l_discount + 0.01."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_quantity") * 1500).alias("pred"),
        F.col("l_extendedprice").alias("gold"),
        (F.col("l_discount") + 0.01).alias("weight"),
    )
