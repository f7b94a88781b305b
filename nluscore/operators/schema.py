"""Schema repair and split handling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_columns(df: DataFrame, roles: Sequence[str], explicit: Mapping[str, str | None] | None = None,
                    known: Mapping[str, Sequence[str]] | None = None, skip=("split", "label", "id", "idx")) -> dict:
    """Role → column: explicit name, else a known name present, else the next free column by position."""
    explicit, known = dict(explicit or {}), dict(known or {})
    cols = list(df.columns)
    out: dict[str, str] = {}
    for role in roles:
        name = explicit.get(role)
        if name:
            if name not in cols:
                raise ValueError(f"column {name!r} for {role!r} not in {cols}")
            out[role] = name
            continue
        hit = next((c for c in known.get(role, ()) if c in cols and c not in out.values()), None)
        if hit is None:
            free = [c for c in cols if c not in out.values() and c not in skip]
            if not free:
                raise ValueError(f"no column left for {role!r}")
            hit = free[0]
        out[role] = hit
    return out


def rename_label(df: DataFrame, name: str, to: str = "label") -> DataFrame:
    """P2."""
    return df if name == to else df.withColumnRenamed(name, to)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P3 (decision R5: the drop really happens)."""
    return df.drop(*[c for c in cols if c in df.columns])


def cast_label(df: DataFrame, col: str, dtype: str) -> DataFrame:
    """Cast with ``try_cast``; a value that does not convert is an error naming the value."""
    c = F.expr(f"try_cast(`{col}` AS {dtype})")
    bad = F.col(col).isNotNull() & c.isNull()
    return df.withColumn(col, F.when(bad, F.raise_error(F.concat(F.lit(f"cannot cast {col} to {dtype}: "),
                                                                  F.col(col).cast("string")))).otherwise(c))


def select_split(df: DataFrame, split: str, rename: Mapping[str, str] | None = None,
                 fallback: Mapping[str, str] | None = None) -> DataFrame:
    """P5: rows of one split after renaming splits; when the split is absent use its fallback
    (e.g. test → validation). The presence check reads only the split column (a pruned scan)."""
    x = df
    if rename:
        m = F.create_map(*[F.lit(v) for kv in rename.items() for v in kv])
        x = x.withColumn("split", F.coalesce(F.element_at(m, F.col("split")), F.col("split")))
    want = split
    if fallback and split in fallback and x.filter(F.col("split") == split).limit(1).count() == 0:
        want = fallback[split]
    return x.filter(F.col("split") == want)


def split_pair(df: DataFrame, split: str, kinds: Sequence[str] = ("matched", "mismatched")) -> dict[str, DataFrame]:
    """P5: a split that comes in several kinds (``validation_matched``, ``validation_mismatched``): kind -> rows, for the kinds
    that are there; a plain split is one entry under its own name."""
    have = {r[0] for r in df.select("split").where(F.col("split").isin([split, *(f"{split}_{k}" for k in kinds)])).distinct().collect()}
    found = {k: df.filter(F.col("split") == f"{split}_{k}") for k in kinds if f"{split}_{k}" in have}
    return found or ({split: df.filter(F.col("split") == split)} if split in have else {})


def head_rows(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in ``order`` (TakeOrderedAndProject: per-partition top-n, no full sort)."""
    return df if n is None else df.orderBy(*order).limit(n)


def shuffle_rows(df: DataFrame, seed: int, key: Sequence[str]) -> DataFrame:
    """Reproducible shuffle by a seeded hash of the key (order differs from the reference RNG)."""
    return df.orderBy(F.xxhash64(*[F.col(k) for k in key], F.lit(seed)), *key)


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """``n`` rows for inspection by the same seeded hash (top-n, no full sort)."""
    return df.orderBy(F.xxhash64(*[F.col(k) for k in key], F.lit(seed)), *key).limit(n)
