"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A normalised text is cut at content-defined places, each chunk gets a verified identifier, and a
document becomes the ordered list of its chunks' identifiers (its recipe). Texts are equal exactly
when their recipes are; only recipes are compared and moved from then on. A chunk's text is
shuffled once, after equal chunks of a task have been merged.

Identifier of a chunk: its XXH64 while no other chunk text has that value. The distinct chunks are
grouped by (value, text), so a clash shows as one value with several texts; chunks with such a
value get an identifier of their own, (value, rank among its texts), through a join on the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, need, stored

#: A chunk ends at the first of these signs after MIN_CHUNK code points, at MAX_CHUNK at the latest.
MIN_CHUNK, MAX_CHUNK = 256, 4096
CUT = r"[.!?;:|,。，،।]"


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def chunks(norm: Column) -> Column:
    """Ordered chunks whose concatenation is the text; no chunks for the empty text."""
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{CUT}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def chunk_value(chunk: Column, mask: int = -1) -> Column:
    """XXH64 of a chunk; ``mask`` keeps fewer bits (tests use it to force clashes)."""
    value = F.xxhash64(chunk)
    return value if mask == -1 else value.bitwiseAND(F.lit(mask))


def chunk_store(docs: DataFrame, text: str = "text", mask: int = -1) -> DataFrame:
    """Distinct chunks of all texts: (value, chunk). Equal chunks are merged before the shuffle."""
    each = need(docs, text).select(F.explode(chunks(normalised(F.col(text)))).alias("chunk"))
    return each.select(chunk_value(F.col("chunk"), mask).alias("value"), "chunk").distinct()


def clashes(docs: DataFrame, text: str = "text", mask: int = -1) -> DataFrame:
    """Values shared by different chunk texts. Expected empty: 64-bit values of distinct chunks."""
    return chunk_store(docs, text, mask).groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")


def recipes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mask: int = -1) -> DataFrame:
    """(id, n_points, text_sha256, recipe) of every row, written once; recipe = verified identifiers in order."""
    clash = stored(clashes(docs, text, mask), "clash")
    rows = need(docs, id_col, text).select(
        F.col(id_col).alias("id"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_points"),
        normalised(F.col(text)).alias("norm"))
    rows = rows.select("id", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
                       chunks(F.col("norm")).alias("parts"))
    if clash.isEmpty():
        plain = rows.select("id", "n_points", "text_sha256", F.transform(
            "parts", lambda c: F.struct(chunk_value(c, mask).alias("value"), F.lit(0).alias("rank"))).alias("recipe"))
        return stored(plain, "recipes")
    # Texts under one value are told apart: each gets the next rank of its value.
    texts = chunk_store(docs, text, mask).join(clash, "value")
    from pyspark.sql import Window

    ranked = texts.withColumn("rank", F.row_number().over(Window.partitionBy("value").orderBy("chunk")))
    keyed = stored(rows.withColumn("row", F.monotonically_increasing_id()), "parts")
    at = keyed.select("row", F.posexplode("parts").alias("pos", "chunk")).withColumn(
        "value", chunk_value(F.col("chunk"), mask))
    named = at.join(ranked, ["value", "chunk"], "left").groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("pos", "value", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("got"))
    out = keyed.join(named, "row", "left").select(
        "id", "n_points", "text_sha256", F.transform(
            F.coalesce("got", F.array().cast("array<struct<pos:int,value:bigint,rank:int>>")),
            lambda x: F.struct(x["value"].alias("value"), x["rank"].alias("rank"))).alias("recipe"))
    return stored(out, "recipes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mask: int = -1) -> DataFrame:
    """Groups of equal texts: (doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Null texts count as empty; empty texts form one group. Of a group the longest original text
    stays, then the smallest id; null ids come last. Rows that repeat the id that stays are that
    same document and are marked kept with it. Extra columns are ignored.

    A recipe's group is pre-aggregated before its shuffle; members learn their group through an
    equi-join of two written tables, whose hot keys adaptive execution splits.
    """
    r = recipes(docs, id_col, text, mask)
    best = F.min(F.struct((-F.col("n_points")).alias("longest"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    groups = stored(r.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"))
                    .select("recipe", F.col("best.id").alias("keep_id"), "group_size"), "groups")
    return r.join(groups, "recipe").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
