"""Fixture query for contrastive training tuples over ``embeddings``.

Instance = every vector; positives = the other vectors of its label (shuffle pick, X2);
negatives = vectors of label (label + 1) mod 10, 3 per instance, round robin (X6); epoch 1, seed 42.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tuples as X
from .tables import load

K, EPOCH, SEED = 3, 1, 42


def training_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (query_id, position, doc_id); position 0 = positive."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    members = X.index_members(e, "label", "vec_id", "vec_id")
    inst = members.select(F.col("_item").alias("query_id"), F.col("label").alias("pos_group"),
                          F.col("idx").alias("self_idx"),
                          F.pmod(F.col("label") + 1, F.lit(10)).alias("neg_group"))
    pos = X.pick_positive(inst, members, "query_id", "pos_group", "self_idx", EPOCH, SEED, shuffle=True)
    neg = X.pick_negatives(inst, members, "query_id", "neg_group", K, EPOCH, SEED, shuffle=False)
    tup = X.training_tuples(pos.select("query_id", "positive"), neg.select("query_id", "position", "negative"), "query_id")
    flat = X.explode_docs(tup, "query_id")
    return flat.select("query_id", F.col("position").cast("long").alias("position"), F.col("doc").alias("doc_id"))


def borrowed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three neighbours; an even vector has the next group's members as its negatives, an odd one none; five
    negatives each, the missing ones borrowed from other instances."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 3").alias("grp"))
    members = X.index_members(e, "grp", "vec_id", "vec_id")
    inst = members.select(F.col("_item").alias("query_id"), F.col("grp").alias("pos_group"), F.col("idx").alias("self_idx"),
                          F.when(F.col("_item") % 2 == 0, F.col("grp") + 1).otherwise(F.lit(-1)).alias("neg_group"))
    got = X.borrow_negatives(inst, members, "query_id", "pos_group", "neg_group", "self_idx", 5, EPOCH, SEED)
    return got.select("query_id", "position", F.col("negative").alias("doc_id"))


def shuffled_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives of label (label + 1) mod 10 per vector, over a permutation of the group of its own."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    members = X.index_members(e, "label", "vec_id", "vec_id")
    inst = members.select(F.col("_item").alias("query_id"), F.pmod(F.col("label") + 1, F.lit(10)).alias("neg_group"))
    neg = X.pick_negatives(inst, members, "query_id", "neg_group", K, EPOCH, SEED, shuffle=True)
    return neg.select("query_id", F.col("position").cast("long").alias("position"), F.col("negative").alias("doc_id"))
