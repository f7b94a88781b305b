"""Sequence labelling: chunk extraction (N1) and entity-level / token-level metrics.

A tag sequence is one array per sentence. Chunks follow the lenient prefix rule literally
(prefix = first character, type = text after the first '-' of the rest, '_' if empty). The chunk
kernel is vectorised with numpy over a whole Arrow batch (per-element JVM lambdas are
interpreted and ~50x slower); nothing is exploded or shuffled until the per-type counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.slices import in_slices
from .metrics_table import as_list, safe_ratio, to_long

ENTITY_TYPE = "array<struct<type:string,start:int,end:int>>"


@lru_cache(maxsize=1 << 16)
def _parse_tag(tag: str, suffix: bool) -> tuple[str, str]:
    """(prefix, type) of a tag under the lenient rule; '_' for an empty type."""
    if suffix:
        return tag[-1:], (tag[:-1].rsplit("-", maxsplit=1)[0] or "_")
    return tag[:1], (tag[1:].split("-", maxsplit=1)[-1] or "_")


def _laid_out(tags: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Tags of all rows end to end as dictionary codes (null: "O"), the distinct tags, and the bounds of each row."""
    lens = pc.fill_null(pc.list_value_length(tags), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(tags.flatten(), "O").dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary, np.concatenate(([0], np.cumsum(lens)))


def _chunks(tags: pa.Array, suffix: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """All chunks of a batch: (row, type number, start, end) in order, and the types' names.

    Rows are laid end to end, each followed by an 'O' sentinel; flags come from each tag and its
    predecessor (reset at row starts); every chunk end pairs with the latest start before it in the
    same row (the row start when there is none).
    """
    codes, names, bounds = _laid_out(tags)
    parsed = [_parse_tag(x, suffix) for x in names.to_pylist()] + [_parse_tag("O", suffix)]
    types = sorted({t for _, t in parsed})
    number = {t: k for k, t in enumerate(types)}
    rows = len(bounds) - 1
    flat = np.insert(codes, bounds[1:], len(parsed) - 1)
    row_start = bounds[:-1] + np.arange(rows)
    pre = np.array([ord(p) if p else 0 for p, _ in parsed])[flat]
    typ = np.array([number[t] for _, t in parsed])[flat]
    ppre, ptyp = np.empty_like(pre), np.empty_like(typ)
    ppre[1:], ptyp[1:] = pre[:-1], typ[:-1]
    ppre[row_start], ptyp[row_start] = ord("O"), -1
    diff = ptyp != typ

    def among(x: np.ndarray, letters: str) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        for c in letters:
            out |= x == ord(c)
        return out

    end = among(ppre, "ES") | (among(ppre, "BI") & among(pre, "BSO")) | (~among(ppre, "O.") & diff)
    start = among(pre, "BS") | (among(ppre, "ESO") & among(pre, "EI")) | (~among(pre, "O.") & diff)
    ends, starts = np.flatnonzero(end), np.flatnonzero(start)
    row = np.searchsorted(row_start, ends, side="right") - 1
    k = np.searchsorted(starts, ends, side="left") - 1
    first = row_start[row]
    cand = np.where(k >= 0, starts[np.maximum(k, 0)], -1) if len(starts) else np.full(len(ends), -1)
    return row, ptyp[ends], np.maximum(cand, first) - first, ends - 1 - first, types


_CHUNKS_TYPE = T.StructType([T.StructField("type", T.ArrayType(T.StringType())),
                             T.StructField("start", T.ArrayType(T.IntegerType())),
                             T.StructField("end", T.ArrayType(T.IntegerType()))])


def _chunk_lists(tags: pa.Array, suffix: bool) -> pa.Array:
    row, typ, start, end, types = _chunks(tags, suffix)
    at = pa.array(np.searchsorted(row, np.arange(len(tags) + 1)).astype(np.int32))
    cols = [pa.array(types, pa.string()).take(pa.array(typ)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, c) for c in cols], names=["type", "start", "end"])


@F.arrow_udf(_CHUNKS_TYPE)
@in_slices
def _chunks_prefix(tags: pa.Array) -> pa.Array:
    return _chunk_lists(tags, False)


@F.arrow_udf(_CHUNKS_TYPE)
@in_slices
def _chunks_suffix(tags: pa.Array) -> pa.Array:
    return _chunk_lists(tags, True)


def extract_entities(df: DataFrame, tags: str, out: str = "entities", suffix: bool = False) -> DataFrame:
    """Add ``out`` = array<struct<type, start, end>> (inclusive token positions)."""
    c = (_chunks_suffix if suffix else _chunks_prefix)(F.col(tags))
    x = df.withColumn("_ch", c)
    z = F.arrays_zip(F.col("_ch.type").alias("type"), F.col("_ch.start").alias("start"), F.col("_ch.end").alias("end"))
    return x.withColumn(out, z).drop("_ch")


# Strict schemes (N2): prefixes each scheme allows, and the chunk grammar it implies.
# start(prev, cur), inside(prev, cur) and end_ok(last) decide a chunk; a malformed chunk is dropped.
_SCHEMES = {
    "IOB1": {"allowed": "IOB"},
    "IOB2": {"allowed": "IOB"},
    "IOE1": {"allowed": "IOE"},
    "IOE2": {"allowed": "IOE"},
    "IOBES": {"allowed": "IOBES"},
    "BILOU": {"allowed": "BILOU"},
}


def _strict_rules(scheme: str):
    same = lambda p, c: p[1] == c[1]
    if scheme == "IOB1":
        start = lambda p, c: (c[0] == "I" and (p[0] == "O" or not same(p, c))) or (c[0] == "B" and p[0] in "IB" and same(p, c))
        inside = lambda p, c: c[0] == "I" and p[0] in "IB" and same(p, c)
        end_ok = lambda last: True
    elif scheme == "IOB2":
        start = lambda p, c: c[0] == "B"
        inside = lambda p, c: c[0] == "I" and p[0] in "BI" and same(p, c)
        end_ok = lambda last: True
    elif scheme == "IOE1":
        # I marks inside words and ends; E is only used where a chunk ends right before another of its type
        start = lambda p, c: c[0] == "I" and (p[0] in "OE" or not same(p, c))
        inside = lambda p, c: c[0] in "IE" and p[0] == "I" and same(p, c)
        end_ok = lambda last: True
    elif scheme == "IOE2":
        start = lambda p, c: c[0] in "IE" and (p[0] in "OE" or not same(p, c))
        inside = lambda p, c: c[0] in "IE" and p[0] == "I" and same(p, c)
        end_ok = lambda last: last[0] == "E"
    else:
        b, i, e, s = ("B", "I", "E", "S") if scheme == "IOBES" else ("B", "I", "L", "U")
        start = lambda p, c: c[0] in (b, s)
        inside = lambda p, c: p[0] in (b, i) and c[0] in (i, e) and same(p, c)
        end_ok = lambda last: last[0] in (e, s)
    return start, inside, end_ok


def strict_chunks(tags: list[str], scheme: str, suffix: bool = False) -> list[tuple[str, int, int]]:
    """Chunks of one sequence under a strict scheme; an unknown scheme or a prefix the scheme
    does not allow is an error."""
    if scheme not in _SCHEMES:
        raise ValueError(f"scheme should be one of {sorted(_SCHEMES)}, got {scheme!r}")
    allowed = _SCHEMES[scheme]["allowed"]
    toks = []
    for t in tags:
        pre, rest = (t[-1:], t[:-1]) if suffix else (t[:1], t[1:])
        if pre not in allowed:
            raise ValueError(f"tag {t!r} not valid in {scheme}")
        toks.append((pre, rest.strip("-") or "_"))
    start, inside, end_ok = _strict_rules(scheme)
    out, i, prev = [], 0, ("O", "_")
    n = len(toks)
    while i < n:
        cur = toks[i]
        if cur[0] != "O" and start(prev, cur):
            j = i + 1
            while j < n and inside(toks[j - 1], toks[j]):
                j += 1
            if end_ok(toks[j - 1]):
                out.append((cur[1], i, j - 1))
            i = j
        else:
            i += 1
        prev = toks[i - 1]
    return out


def _strict_udf(scheme: str, suffix: bool):
    @F.pandas_udf(_CHUNKS_TYPE)
    def chunks(tags: pd.Series) -> pd.DataFrame:
        t, st, en = [], [], []
        for seq in tags:
            c = strict_chunks(list(seq) if seq is not None else [], scheme, suffix)
            t.append([x[0] for x in c])
            st.append(np.array([x[1] for x in c], dtype=np.int32))
            en.append(np.array([x[2] for x in c], dtype=np.int32))
        return pd.DataFrame({"type": t, "start": st, "end": en})
    return chunks


def extract_entities_strict(df: DataFrame, tags: str, scheme: str, out: str = "entities",
                            suffix: bool = False) -> DataFrame:
    """Like ``extract_entities`` under a strict scheme (IOB1, IOB2, IOE1, IOE2, IOBES, BILOU)."""
    if scheme not in _SCHEMES:
        raise ValueError(f"scheme should be one of {sorted(_SCHEMES)}, got {scheme!r}")
    x = df.withColumn("_ch", _strict_udf(scheme, suffix)(F.col(tags)))
    z = F.arrays_zip(F.col("_ch.type").alias("type"), F.col("_ch.start").alias("start"), F.col("_ch.end").alias("end"))
    return x.withColumn(out, z).drop("_ch")


def _agreeing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Positions where two tag sequences agree, per row, up to the end of the shorter."""
    both = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    la, lb = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    n = np.minimum(la, lb)
    before = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(before, n)
    ca = both[np.repeat(np.cumsum(la) - la, n) + at]
    cb = both[la.sum() + np.repeat(np.cumsum(lb) - lb, n) + at]
    hits = np.concatenate(([0], np.cumsum((ca == cb) & ~np.isnan(ca))))
    return hits[before + n] - hits[before]


@F.arrow_udf(T.LongType())
@in_slices
def _equal_positions(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of positions where two tag sequences agree (vectorised over the batch)."""
    return pa.array(_agreeing(a, b).astype(np.int64))


_COUNT_FIELDS = ("g", "p", "tp", "hit", "n")
_COUNTS_TYPE = T.ArrayType(T.StructType([T.StructField("type", T.StringType())] + [T.StructField(c, T.LongType()) for c in _COUNT_FIELDS]))


def _tag_counts_udf(suffix: bool):
    @F.arrow_udf(_COUNTS_TYPE)
    @in_slices
    def counts(gold: pa.Array, pred: pa.Array) -> pa.Array:
        """Per row: gold, predicted and matching chunks of each type, then of all types with agreeing and all positions."""
        rows = len(gold)
        sides = [_chunks(x, suffix) for x in (gold, pred)]
        names = sorted({*sides[0][4], *sides[1][4]}) + ["overall"]
        number = {t: k for k, t in enumerate(names)}
        of = [np.array([number[t] for t in s[4]], dtype=np.int64)[s[1]] for s in sides]
        wide = int(max([1, *(int(s[3].max(initial=0)) + 2 for s in sides)]))
        # a chunk as one number, unique in its row: chunks of a side start at different places
        keys = [(s[0] * wide + s[2]) for s in sides]
        both, ig, ip = np.intersect1d(keys[0], keys[1], assume_unique=True, return_indices=True)
        same = ig[(sides[0][3][ig] == sides[1][3][ip]) & (of[0][ig] == of[1][ip])]
        width = len(names)
        slot = [sides[0][0] * width + of[0], sides[1][0] * width + of[1], (sides[0][0] * width + of[0])[same]]
        total = [s // width * width + width - 1 for s in slot]
        every = np.arange(rows) * width + width - 1
        used, place = np.unique(np.concatenate([*slot, *total, every]), return_inverse=True)
        cuts = np.cumsum([0, *(len(x) for x in (*slot, *total))])
        cols = [np.bincount(np.concatenate([place[cuts[k]:cuts[k + 1]], place[cuts[k + 3]:cuts[k + 4]]]), minlength=len(used)) for k in range(3)]
        hit, n = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
        hit[place[cuts[6]:]] = _agreeing(gold, pred)
        n[place[cuts[6]:]] = pc.fill_null(pc.list_value_length(gold), 0).to_numpy(zero_copy_only=False)
        fields = [pa.array(names, pa.string()).take(pa.array(used % width)), *(pa.array(c.astype(np.int64)) for c in (*cols, hit, n))]
        at = np.searchsorted(used // width, np.arange(rows + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, names=["type", *_COUNT_FIELDS]))
    return counts


def tag_counts(df: DataFrame, gold_tags: str, pred_tags: str, by=None, weight: str | None = None, suffix: bool = False) -> DataFrame:
    """N1, J10 and N5 in one step: the counts of :func:`entity_counts` straight from two tag columns. One kernel
    leaves a few numbers a row and type; tags and chunks are never shuffled or sent back."""
    by = as_list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = df.select(*by, w.alias("_w"), F.explode_outer(_tag_counts_udf(suffix)(F.col(gold_tags), F.col(pred_tags))).alias("_e"))
    named = {"n_gold": "g", "n_pred": "p", "n_tp": "tp", "n_hit": "hit", "n_tok": "n"}
    return x.groupBy(*by, F.col("_e.type").alias("type")).agg(*(F.sum(F.col("_w") * F.col(f"_e.{c}")).alias(n) for n, c in named.items()))


_PAIR_FIELDS = ("g", "p", "tp")
_PAIRS_TYPE = T.ArrayType(T.StructType([T.StructField("type", T.StringType())] + [T.StructField(c, T.LongType()) for c in _PAIR_FIELDS]))


@F.arrow_udf(_PAIRS_TYPE)
@in_slices
def _entity_pairs(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """J10 per row: gold entities, predicted ones and distinct common ones of each type, then of all types ("overall").
    Entities are equal when all their fields are (nulls too); a row without either list has no counts."""
    rows = len(gold)
    lens = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (gold, pred)]
    row = np.concatenate([np.repeat(np.arange(rows), n) for n in lens])
    ents = pa.concat_arrays([gold.flatten(), pred.flatten()])
    side = np.arange(len(row)) >= lens[0].sum()

    def numbered(x: pa.Array) -> tuple[np.ndarray, pa.Array]:
        coded = x.dictionary_encode(null_encoding="encode")
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    # an entity as one number: the row, then every field, numbered anew after each
    fields = {f.name: numbered(pc.struct_field(ents, f.name)) for f in ents.type}
    key = row * 2 + ents.is_valid().to_numpy(zero_copy_only=False)
    for code, names in fields.values():
        key = np.unique(key * max(len(names), 1) + code, return_inverse=True)[1]
    typ, names = fields["type"]
    shared, at, _ = np.intersect1d(key[~side], key[side], return_indices=True)
    common = np.flatnonzero(~side)[at] if len(shared) else np.zeros(0, np.int64)
    width = len(names) + 1
    both = (pc.is_valid(gold).to_numpy(zero_copy_only=False) & pc.is_valid(pred).to_numpy(zero_copy_only=False))[row]
    picks = [np.flatnonzero(~side & both), np.flatnonzero(side & both), common[both[common]]]
    slot = [np.concatenate([row[k] * width + typ[k], row[k] * width + width - 1]) for k in picks]
    used, place = np.unique(np.concatenate(slot), return_inverse=True)
    cuts = np.cumsum([0, *(len(x) for x in slot)])
    cols = [np.bincount(place[cuts[k]:cuts[k + 1]], minlength=len(used)).astype(np.int64) for k in range(3)]
    every = pa.concat_arrays([names.cast(pa.string()), pa.array(["overall"], pa.string())])
    made = pa.StructArray.from_arrays([every.take(pa.array(used % width)), *(pa.array(c) for c in cols)], names=["type", *_PAIR_FIELDS])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(used // width, np.arange(rows + 1)).astype(np.int32)), made)


def entity_counts(df: DataFrame, gold: str, pred: str, by=None, weight: str | None = None,
                  gold_tags: str | None = None, pred_tags: str | None = None) -> DataFrame:
    """Per (by, type) — plus type ``overall`` — gold, pred and true-positive entity counts (J10 as a
    per-row set intersection), and with tag columns the token hits/total (N5), all in ONE explode and
    one partially aggregated ``groupBy``. With ``weight`` a sentence counts with its weight (N7).

    A row leaves a few counts a type (one kernel over slices of an Arrow batch), never a row per entity."""
    by = as_list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    zero = F.lit(0.0)

    def rec(typ, g, p, t, hit=zero, n=zero):
        return F.struct(typ.alias("type"), g.alias("g"), p.alias("p"), t.alias("tp"), hit.alias("hit"), n.alias("n"))

    found = F.when(F.col(gold).isNotNull() & F.col(pred).isNotNull(), F.transform(
        _entity_pairs(F.col(gold), F.col(pred)), lambda e: rec(e["type"], w * e["g"], w * e["p"], w * e["tp"])))
    parts = [found]
    if gold_tags and pred_tags:
        hits = _equal_positions(F.col(gold_tags), F.col(pred_tags)).cast("double")
        parts.append(F.array(rec(F.lit("overall"), zero, zero, zero, w * hits, w * F.size(F.col(gold_tags)))))
    x = df.select(*by, F.explode_outer(F.concat(*parts)).alias("_e")).filter(F.col("_e").isNotNull())
    return x.groupBy(*by, F.col("_e.type").alias("type")).agg(
        F.sum("_e.g").alias("n_gold"), F.sum("_e.p").alias("n_pred"), F.sum("_e.tp").alias("n_tp"),
        F.sum("_e.hit").alias("n_hit"), F.sum("_e.n").alias("n_tok"))


def entity_report(df: DataFrame, gold: str, pred: str, by=None, zero_division: float = 0.0,
                  weight: str | None = None, gold_tags: str | None = None, pred_tags: str | None = None) -> DataFrame:
    """N3/N4(/N5): per type precision, recall, f1, number (support); ``overall`` precision, recall,
    f1 and, when tag columns are given, token accuracy — from one aggregation."""
    return report_from_counts(entity_counts(df, gold, pred, by, weight, gold_tags, pred_tags), by, zero_division,
                              accuracy=bool(gold_tags and pred_tags))


def entity_report_from_tags(df: DataFrame, gold_tags: str, pred_tags: str, by=None, zero_division: float = 0.0,
                            weight: str | None = None, suffix: bool = False) -> DataFrame:
    """N1, N3-N5 from two tag columns: the report of :func:`entity_report`, see :func:`tag_counts`."""
    return report_from_counts(tag_counts(df, gold_tags, pred_tags, by, weight, suffix), by, zero_division)


def report_from_counts(c: DataFrame, by=None, zero_division: float = 0.0, accuracy: bool = True) -> DataFrame:
    """Long report of counts per (by, type)."""
    by = as_list(by)
    p = safe_ratio(F.col("n_tp"), F.col("n_pred"), zero_division)
    r = safe_ratio(F.col("n_tp"), F.col("n_gold"), zero_division)
    f = F.when(p + r == 0, F.lit(zero_division)).otherwise(2 * p * r / (p + r))
    metrics = ["precision", "recall", "f1", "number"] + (["accuracy"] if accuracy else [])
    wide = c.select(*by, "type", p.alias("precision"), r.alias("recall"), f.alias("f1"),
                    F.when(F.col("type") != "overall", F.col("n_gold")).alias("number"),
                    F.when(F.col("type") == "overall", safe_ratio(F.col("n_hit"), F.col("n_tok"))).alias("accuracy"))
    # the overall row carries no support count; accuracy exists only on the overall row
    return to_long(wide, [*by, "type"], metrics).filter(F.col("value").isNotNull())


def tag_accuracy(df: DataFrame, gold: str, pred: str, by=None) -> DataFrame:
    """N5 on its own: token accuracy over all positions."""
    by = as_list(by)
    agg = df.groupBy(*by).agg(F.sum(_equal_positions(F.col(gold), F.col(pred))).alias("_h"),
                              F.sum(F.size(F.col(gold))).alias("_n"))
    return agg.select(*by, safe_ratio(F.col("_h"), F.col("_n")).alias("accuracy"))


def flatten_report(long_df: DataFrame, overall_only: bool = False) -> DataFrame:
    """``type_metric`` names (``overall_f1`` ...), or only the overall metrics."""
    x = long_df.filter(F.col("type") == "overall") if overall_only else long_df
    return x.withColumn("metric", F.concat_ws("_", "type", "metric")).drop("type")
