"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, BPE.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns
of ``docs`` (the last: ids and digests of each text). A stage's result is written as Parquet and read
again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nluscore.llm import bpe, common, exact_dedup, langid, mixing, simhash
from nluscore.llm.queries import tokenizer_path


def keyed(docs: DataFrame) -> DataFrame:
    """(row, key, text): all columns in one struct, whatever their names; a key that only copies share, (id is null, id,
    digest of the text), null ids last; the text."""
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    key = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), digest.alias("digest"))
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), key.alias("key"), docs["text"].alias("text"))


def chosen(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``docs`` for every key in ``rows`` (column key, once for each row of ``docs`` with it), with the columns of ``docs``.

    Of rows that share id and text, that with the greatest JSON form stays: any columns may differ, maps too.
    """
    keys = common.stored(rows.groupBy("key").agg(F.count("*").alias("n")).select("key.id", "key.digest", "n"), "chosen")

    def of(some: DataFrame) -> DataFrame:
        d = keyed(docs)
        return d.join(some, d["key.id"].eqNullSafe(some["id"]) & (d["key.digest"] == some["digest"]), "left_semi")

    def unpacked(some: DataFrame) -> DataFrame:
        return some.select(*(F.col("row")[c].alias(c) for c in docs.columns))

    once = unpacked(of(keys.where("n = 1")))
    copies = keys.where("n > 1")
    if copies.isEmpty():
        return once
    return once.unionByName(unpacked(of(copies).groupBy("key").agg(F.max_by("row", F.to_json("row")).alias("row"))))


#: Rows of an Arrow batch: whole texts go to Python workers and back, so batches are kept to a few megabytes.
ARROW_ROWS = 2000


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with Arrow batches of at most ARROW_ROWS rows, unless the session asks for another size than Spark's own."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name, own = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
        if spark.conf.get(name, own) == own:
            spark.conf.set(name, str(ARROW_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (``und``: null text or no letter) go, all others stay."""
    held = common.crc_of_id(F.col("doc_id")) % 3 == 1
    model = langid.Model(langid.training_texts(docs, ~held))
    # columns go by place: their names can't meet those of the prediction
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    named = langid.identify(plain, model, f"c{docs.columns.index('text')}", tuple(plain.columns))
    return named.where("lang_pred != 'und'").select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


@bounded
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts that are equal but for white space: the longest text, then the smallest id; null ids last."""
    groups = exact_dedup.exact_dedup(keyed(docs), "key")
    return chosen(docs, groups.where("kept").select(F.col("keep_id").alias("key")))


@bounded
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every SimHash group: that with the smallest id, null ids last."""
    groups = simhash.simhash_dedup(keyed(docs), "key", words=4, bits=4)
    return chosen(docs, groups.where("doc_id <=> component_id").select(F.col("component_id").alias("key")))


@bounded
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights; a document taken more than once is there more than once."""
    return mixing.mixed_documents(docs)


@bounded
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("mixing", mix_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express language ID, SimHash, the mix's permutations or BPE: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
