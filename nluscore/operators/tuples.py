"""Contrastive training tuples (X1-X8) without materialising candidate lists.

Positives and negatives are *groups* of a member table (e.g. all items with the instance's label,
all items of another label). Each member gets a dense index inside its group (distributed W7, so
a hot group is split over many tasks) and every choice below is index arithmetic followed by an
equi-join on ``(group, idx)``: no per-instance lists, no pairs within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.permute import item_key, permuted
from ..session import cut_lineage
from .prefix import with_row_id


def index_members(members: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """``(group, idx, item, n)``: dense 0-based index of each member inside its group and the group size; written once,
    so that every use reads it."""
    cols = list(dict.fromkeys([group, order, item]))
    m = with_row_id(members.select(*cols).dropDuplicates([group, order]), [order], "idx", by=group)
    n = m.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(m.join(n, group).select(group, "idx", F.col(item).alias("_item"), "n"))


def _fetch(picks: DataFrame, members: DataFrame, group_expr: str, idx: str, out: str) -> DataFrame:
    m = members.select(F.col(members.columns[0]).alias("_g"), F.col("idx").alias("_i"), F.col("_item").alias(out))
    return picks.join(m, (F.col(group_expr) == F.col("_g")) & (F.col(idx) == F.col("_i")), "inner").drop("_g", "_i")


def pick_positive(inst: DataFrame, members: DataFrame, item: str, group: str, self_idx: str | None,
                  epoch: int, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """positive = list[(item + seed + epoch) mod n] (shuffle) or list[epoch mod n] (rotate), where
    the list is the group without the instance itself when ``self_idx`` is given."""
    sizes = members.groupBy(F.col(members.columns[0]).alias("_g")).agg(F.first("n").alias("n"))
    x = inst.join(sizes, F.col(group) == F.col("_g"), "inner").drop("_g")
    n = F.col("n") - (1 if self_idx else 0)
    j = F.pmod(F.col(item) + seed + epoch, n) if shuffle else F.pmod(F.lit(epoch), n)
    if self_idx:
        j = F.when(j < F.col(self_idx), j).otherwise(j + 1)
    x = x.filter(n > 0).withColumn("_pidx", j).drop("n")
    return _fetch(x, members, group, "_pidx", "positive").drop("_pidx")


def pick_negatives(inst: DataFrame, members: DataFrame, item: str, group: str, k: int, epoch: int,
                   seed: int = 42, shuffle: bool = False, safe: bool = True) -> DataFrame:
    """``k`` negatives from the instance's negative group → rows ``(…, position, negative)``.

    m >= k: round robin from ``epoch*k mod m`` (X6) or the same slide over a keyed permutation of the
    group, one per instance (X5); 0 < m < k with ``safe``: k hashed draws with replacement (X3).
    Draws are deterministic and partition-independent (not the reference's generator).
    """
    sizes = members.groupBy(F.col(members.columns[0]).alias("_g")).agg(F.first("n").alias("m"))
    x = inst.join(sizes, F.col(group) == F.col("_g"), "inner").drop("_g")
    x = x.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    m = F.col("m")
    slot = F.pmod(F.lit(epoch * k) + F.col("t"), m)
    if shuffle:
        slot = permuted(slot, m, item_key(F.col(item), seed))
    draw = F.pmod(F.xxhash64(F.col(item), F.lit(seed), F.col("t")), m)
    enough = m >= k
    x = x.filter(enough | (F.lit(safe) & (m > 0))).withColumn("_nidx", F.when(enough, slot).otherwise(draw))
    out = _fetch(x, members, group, "_nidx", "negative")
    return out.withColumn("position", F.col("t") + 1).drop("_nidx", "t", "m")


def borrow_negatives(inst: DataFrame, members: DataFrame, item: str, pos_group: str, neg_group: str,
                     self_idx: str, k: int, epoch: int, seed: int = 42) -> DataFrame:
    """X4 (J12): instances with m < k negatives (and ``safe`` off) keep their own m negatives and borrow from other
    instances: a keyed permutation of all instances that have candidates names 2k different ones (all, where there are
    fewer); self is skipped, and each gives the candidate ``(item + seed + epoch) mod |its positives + negatives|``, until
    k. So k come out whenever k other instances have a candidate. Everything is index arithmetic and
    equi-joins on unique keys.

    Returns ``(item, position, negative)`` with positions 1..k (own negatives first).
    """
    group = members.columns[0]
    sizes = members.groupBy(F.col(group).alias("_g")).agg(F.first("n").alias("_n"))
    named = inst.select(F.col(item).alias("_item0"), F.col(pos_group).alias("_pg"), F.col(neg_group).alias("_ng"), F.col(self_idx).alias("_self"))
    named = named.join(sizes.select(F.col("_g").alias("_pg"), F.col("_n").alias("_np")), "_pg", "left")
    named = named.join(sizes.select(F.col("_g").alias("_ng"), F.col("_n").alias("_nn")), "_ng", "left")
    named = named.select("_item0", "_pg", "_ng", "_self", (F.coalesce("_np", F.lit(1)) - 1).alias("_np"), F.coalesce("_nn", F.lit(0)).alias("m"))
    named = cut_lineage(named.withColumn("_tot", F.col("_np") + F.col("m")))
    donors = cut_lineage(with_row_id(named.filter(F.col("_tot") > 0), ["_item0"], "_slot"))
    n = donors.count()
    x = named.filter(F.col("m") < k)
    own = x.filter(F.col("m") > 0).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    own = _fetch(own, members, "_ng", "t", "negative").select(F.col("_item0").alias(item), (F.col("t") + 1).cast("long").alias("position"), "negative")
    if not n:
        return own
    # draws in order d, self skipped
    d = x.join(donors.select("_item0", "_slot"), "_item0", "left").select("_item0", "m", "_slot", F.explode(F.sequence(F.lit(0), F.lit(min(2 * k, n) - 1))).alias("d"))
    d = d.withColumn("_other", permuted(F.col("d"), F.lit(n), item_key(F.col("_item0"), seed)))
    d = d.filter(~F.col("_other").eqNullSafe(F.col("_slot")))
    d = d.join(donors.select(F.col("_slot").alias("_other"), F.col("_pg").alias("_opg"), F.col("_ng").alias("_ong"), F.col("_self").alias("_oself"),
                             F.col("_np").alias("_onp"), "_tot"), "_other")
    d = d.withColumn("_c", F.pmod(F.col("_item0") + seed + epoch, F.col("_tot")))
    from_pos = F.col("_c") < F.col("_onp")
    d = d.withColumn("_grp", F.when(from_pos, F.col("_opg")).otherwise(F.col("_ong"))).withColumn(
        "_nidx", F.when(from_pos, F.when(F.col("_c") < F.col("_oself"), F.col("_c")).otherwise(F.col("_c") + 1)).otherwise(F.col("_c") - F.col("_onp")))
    w = Window.partitionBy("_item0").orderBy("d")
    d = d.withColumn("position", F.col("m") + F.row_number().over(w)).filter(F.col("position") <= k)
    b = _fetch(d.select("_item0", "position", "_grp", "_nidx"), members, "_grp", "_nidx", "negative")
    return own.unionByName(b.select(F.col("_item0").alias(item), F.col("position").cast("long").alias("position"), "negative"))


def training_tuples(positives: DataFrame, negatives: DataFrame, query: str) -> DataFrame:
    """``(query, docs = [positive, *negatives])`` from the picks (negatives ordered by position)."""
    negs = negatives.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "negative"))),
                                                    lambda s: s["negative"]).alias("_negs"))
    return positives.join(negs, query, "left").select(
        query, F.concat(F.array("positive"), F.coalesce(F.col("_negs"), F.array().cast(
            T.ArrayType(negatives.schema["negative"].dataType)))).alias("docs"))


def explode_docs(tuples: DataFrame, query: str) -> DataFrame:
    """One row per (query, position, doc); position 0 is the positive."""
    return tuples.select(query, F.posexplode_outer("docs").alias("position", "doc")).filter(F.col("doc").isNotNull())


def as_array(c: Column) -> Column:
    """P12 for tuples: wrap a scalar positive into a list."""
    return F.array(c)


# ---- list-valued instances: {query, positives[], negatives[]} rows (X1) ----

def build_instances(df: DataFrame, query: str, positives: str, negatives: str | None = None) -> DataFrame:
    """X1 + P12: instances with list-valued positives/negatives (scalars are wrapped)."""
    types = dict(df.dtypes)
    pos = F.col(positives) if types[positives].startswith("array") else F.array(F.col(positives))
    cols = [F.col(query).alias("query"), pos.alias("positives")]
    if negatives:
        neg = F.col(negatives) if types[negatives].startswith("array") else F.array(F.col(negatives))
        cols.append(neg.alias("negatives"))
    keep = [c for c in df.columns if c not in (query, positives, negatives)]
    return df.select(*keep, *cols)


def pick_positive_list(item: Column, positives: Column, epoch: int, seed: int = 42, shuffle: bool = True) -> Column:
    """X2 on a list: ``positives[(item + seed + epoch) mod n]`` or, without shuffle, the epoch-th rotation."""
    n = F.size(positives)
    j = F.pmod(item + seed + epoch, n) if shuffle else F.pmod(F.lit(epoch), n)
    return F.element_at(positives, (j + 1).cast("int"))


def pick_negatives_list(item: Column, negatives: Column, k: int, epoch: int, seed: int = 42,
                        shuffle: bool = False, safe: bool = True) -> Column:
    """X3/X5/X6 on a list (an array column, bounded by the instance's own list):
    m >= k: window of k starting at ``epoch*k mod m`` with wrap-around, over a seeded order when
    ``shuffle`` (X5) or the list order (X6); 0 < m < k and ``safe``: k hashed draws (X3)."""
    m = F.size(negatives)
    base = negatives
    if shuffle:
        keyed = F.transform(negatives, lambda x, i: F.struct(F.xxhash64(item, F.lit(seed), x, i).alias("h"), x.alias("v")))
        base = F.transform(F.array_sort(keyed), lambda s: s["v"])
    off = F.pmod(F.lit(epoch * k), m)
    window = F.slice(F.concat(base, base), (off + 1).cast("int"), k)
    draws = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: F.element_at(
        negatives, (F.pmod(F.xxhash64(item, F.lit(seed), t), m) + 1).cast("int")))
    return F.when(m >= k, window).when((m > 0) & F.lit(safe), draws).otherwise(negatives)
