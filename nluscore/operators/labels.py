"""Label vocabularies and ids.

Vocabularies are small tables ``(label, label_id)`` built by distinct + distributed dense ranks;
they join data through a broadcast only after their size is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .metrics_table import as_list
from .prefix import with_row_id

# sentinels at the edge of the data model: unlabelled row, ignored position
UNLABELLED = -1
IGNORED = -100


def label_list(df: DataFrame, col: str, multi: bool = False, drop=(UNLABELLED,)) -> DataFrame:
    """L1/L2: distinct sorted labels with 0-based ids; the ``-1`` sentinel never enters.

    One aggregation pass; the labels are numbered with distributed row ids (W7) at every size.
    """
    # explode_outer: a plain explode lets Catalyst push size(col) > 0 below repartitions and
    # evaluate the (possibly expensive) array twice; nulls are dropped right after
    x = df.select(F.explode_outer(F.col(col)).alias("label") if multi else F.col(col).alias("label"))
    x = x.filter(F.col("label").isNotNull())
    if drop:
        x = x.filter(~F.col("label").cast("string").isin([str(d) for d in drop]))
    return with_row_id(x.distinct(), ["label"], "label_id")


def label_union(dfs: list[DataFrame], col: str, multi: bool = False) -> DataFrame:
    """L3: labels of all splits together."""
    u = dfs[0].select(col)
    for d in dfs[1:]:
        u = u.unionByName(d.select(col))
    return label_list(u, col, multi)


def unseen_labels(train: DataFrame, other: DataFrame, col: str, by=None) -> DataFrame:
    """L3 report: labels of ``other`` (per ``by`` key, e.g. split) that ``train`` never has."""
    by = as_list(by)
    seen = train.select(F.col(col).alias("label")).distinct()
    o = other.select(*by, F.col(col).alias("label")).distinct()
    return o.join(seen, "label", "left_anti")


def encode_label(df: DataFrame, vocab: DataFrame, col: str, out: str = "label_id",
                 case_insensitive: bool = False) -> DataFrame:
    """L4: label → id through the vocabulary; ``-1`` stays ``-1``; an unknown label is an error."""
    v = vocab.select(F.col("label").alias("_vl"), F.col("label_id").alias(out))
    key_l = F.lower(F.col(col).cast("string")) if case_insensitive else F.col(col).cast("string")
    key_r = F.lower(F.col("_vl").cast("string")) if case_insensitive else F.col("_vl").cast("string")
    j = df.withColumn("_k", key_l).join(v.withColumn("_vk", key_r),
                                        F.col("_k") == F.col("_vk"), "left")
    sentinel = F.col(col).cast("string") == str(UNLABELLED)
    res = F.when(sentinel, F.lit(UNLABELLED).cast("long")).when(F.col(col).isNull(), F.lit(None).cast("long")).when(
        F.col(out).isNull(), F.raise_error(F.concat(F.lit("label not in vocabulary: "), F.col(col).cast("string")))
    ).otherwise(F.col(out).cast("long"))
    return j.withColumn(out, res).drop("_k", "_vk", "_vl")


def encode_multihot(ids: Column, n_labels: int) -> Column:
    """Label ids → float multi-hot vector of length ``n_labels``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)),
                       lambda i: F.array_contains(ids, i).cast("float"))


def decode_label(df: DataFrame, vocab: DataFrame, col: str, out: str = "label") -> DataFrame:
    """Id → label (broadcast vocabulary)."""
    v = vocab.select(F.col("label_id").alias("_id"), F.col("label").alias(out))
    return df.join(v, F.col(col) == F.col("_id"), "left").drop("_id")


def decode_multihot(hot: Column, labels_in_id_order: Column) -> Column:
    """Multi-hot vector → list of labels (``labels_in_id_order`` is an array literal/column)."""
    return F.transform(F.filter(F.arrays_zip(hot.alias("h"), labels_in_id_order.alias("l")),
                                lambda z: z["h"] > 0), lambda z: z["l"])


def align_vocab(data_vocab: DataFrame, model_vocab: DataFrame, case_insensitive: bool = True) -> DataFrame:
    """Map dataset ids to the model's ids when the label sets match; rows ``matched=false`` are the
    mismatches (the caller keeps the data ids and warns)."""
    k = (lambda c: F.lower(F.col(c).cast("string"))) if case_insensitive else (lambda c: F.col(c).cast("string"))
    d = data_vocab.select(k("label").alias("_k"), F.col("label").alias("data_label"), F.col("label_id").alias("data_id"))
    m = model_vocab.select(k("label").alias("_k"), F.col("label").alias("model_label"),
                           F.col("label_id").alias("model_id"))
    j = d.join(m, "_k", "full_outer")
    return j.withColumn("matched", F.col("data_id").isNotNull() & F.col("model_id").isNotNull()).drop("_k")


def settle_vocab(data_vocab: DataFrame, model_vocab: DataFrame, case_insensitive: bool = True) -> tuple[DataFrame, bool]:
    """L7 decided: (vocabulary to use, whether it has the model's ids). The model's ids are taken when the two label sets are
    the same (up to case); otherwise the data's vocabulary stays as it is."""
    both = align_vocab(data_vocab, model_vocab, case_insensitive)
    counts = both.agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("same")).first()
    if counts["n"] == 0 or counts["n"] != counts["same"]:
        return data_vocab.select("label", "label_id"), False
    return both.select(F.col("data_label").alias("label"), F.col("model_id").alias("label_id")), True


def b_to_i(vocab: DataFrame) -> DataFrame:
    """For each tag id, the id of its ``I-`` form when the tag is ``B-x`` and ``I-x`` exists, else itself."""
    v = vocab.select("label", "label_id")
    i_side = v.select(F.col("label").alias("_il"), F.col("label_id").alias("_iid"))
    j = v.withColumn("_want", F.regexp_replace("label", "^B-", "I-")).join(
        i_side, F.col("_want") == F.col("_il"), "left")
    return j.select("label", "label_id", F.coalesce(F.col("_iid"), F.col("label_id")).alias("label_all_id"))


def infer_problem(df: DataFrame, col: str) -> str:
    """Float label → regression; list → multi-label; else single-label (needs ≥ 2 labels)."""
    t = dict(df.dtypes)[col]
    if t in ("float", "double"):
        return "regression"
    kind = "multi_label_classification" if t.startswith("array") else "single_label_classification"
    x = df.select(F.explode_outer(col).alias("l")) if t.startswith("array") else df.select(F.col(col).alias("l"))
    n = x.filter(F.col("l").isNotNull() & (F.col("l").cast("string") != str(UNLABELLED))).distinct().limit(2).count()
    if n < 2:
        raise ValueError(f"need at least 2 labels in {col!r}, found {n}")
    return kind


def text_key(text: Column) -> Column:
    """128 bits of hash and the length of a text; null texts have a key of their own."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("nluscore"), text).alias("h2"), F.coalesce(F.length(text), F.lit(-1)).alias("len"))


def text_identity(df: DataFrame, text: str, keep: list[str], key=text_key) -> DataFrame:
    """``keep`` columns plus ``_key`` and ``_clash``, which together are equal exactly for equal texts (null is one text).

    Rows are grouped by a hash key. Texts of keys that several rows share are then compared: a key whose smallest and
    greatest text differ holds different texts, which get numbers by their order. Texts that occur
    once never move; of others each map task ships one pair a key.
    """
    whole = F.struct(F.col(text).isNull().alias("none"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    keyed = df.select(*keep, key(F.col(text)).alias("_key"), whole.alias("_t"))
    many = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_key")
    clash = cut_lineage(keyed.join(many, "_key", "left_semi").groupBy("_key").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
                        .filter(F.col("_lo") != F.col("_hi")).select("_key"))
    if clash.isEmpty():
        return keyed.drop("_t").withColumn("_clash", F.lit(0))
    apart = keyed.join(clash, "_key", "left_semi")
    number = F.row_number().over(Window.partitionBy("_key").orderBy("_t")) - 1
    numbered = apart.select("_key", "_t").distinct().withColumn("_clash", number)
    told = apart.join(numbered, ["_key", "_t"]).select(*keep, "_key", "_clash")
    return keyed.join(clash, "_key", "left_anti").select(*keep, "_key", F.lit(0).alias("_clash")).unionByName(told)


def dedupe_corpus(df: DataFrame, text: str = "text", order: str = "doc_id", out: str = "corpus_id", key=text_key) -> DataFrame:
    """Distinct texts get ids in first-seen order; every row gets the id of its text.

    Texts are told apart by :func:`text_identity`: hash keys, verified. Null texts are one text of their own.
    """
    named = text_identity(df, text, [order], key)
    first = named.groupBy("_key", "_clash").agg(F.min(order).alias("_first"))
    ids = with_row_id(first, ["_first"], out)
    return named.join(ids, ["_key", "_clash"], "inner").select(order, out, (F.col(order) == F.col("_first")).alias("is_first"))
