"""Keyed permutations of slots: draws without replacement that need no list, no sort and no shuffle.

Slot i of n goes to a place of its own below n. A balanced Feistel network permutes the smallest range of
2^(2w) numbers that holds n; a number that leaves 0..n-1 is sent through again until it is back (the cycle through i
returns to i < n at the latest), which leaves a permutation of 0..n-1. Rounds use products below 2^62 only, so any
SQL engine with 64-bit integers can follow them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# fixed values: multipliers and per-round increments of the round function, bits of its numbers
MULTIPLIER, SECOND, INCREMENTS, BITS = 1103515245, 1664525 * 2 + 1, (12345, 1013904223, 907633515, 362437), 31
_LOW = (1 << BITS) - 1


def half_bits(n: np.ndarray) -> np.ndarray:
    """w for each n: the smallest with 4^w >= n, at least 1."""
    w = np.ones(len(n), dtype=np.int64)
    while (short := (np.int64(1) << (2 * w)) < n).any():
        w += short
    return w


def feistel(x: np.ndarray, w: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One pass over numbers below 4^w."""
    left, right = x >> w, x & ((np.int64(1) << w) - 1)
    for add in INCREMENTS:
        mixed = (((right + key + add) & _LOW) * MULTIPLIER) & _LOW
        mixed = ((mixed ^ (mixed >> 15)) * SECOND) & _LOW
        left, right = right, left ^ (mixed >> (BITS - w))
    return left << w | right


def permute(slot: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each slot (0 <= slot < n) under the permutation of 0..n-1 that its key names."""
    w = half_bits(n)
    out = feistel(slot, w, key)
    away = np.flatnonzero(out >= n)
    while len(away):
        out[away] = feistel(out[away], w[away], key[away])
        away = away[out[away] >= n[away]]
    return out


@F.arrow_udf(LongType())
def _permuted(slot: pa.Array, n: pa.Array, key: pa.Array) -> pa.Array:
    ok = (slot.is_valid().to_numpy(zero_copy_only=False) & n.is_valid().to_numpy(zero_copy_only=False) & key.is_valid().to_numpy(zero_copy_only=False))
    s, m, k = (np.where(ok, c.fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64) for c in (slot, n, key))
    ok &= (s >= 0) & (s < m)
    out = np.zeros(len(s), dtype=np.int64)
    out[ok] = permute(s[ok], m[ok], k[ok] & _LOW)
    return pa.array(out, mask=~ok)


def permuted(slot: Column, n: Column, key: Column) -> Column:
    """Column of :func:`permute`; null for a null argument or a slot outside 0..n-1."""
    return _permuted(slot.cast("long"), n.cast("long"), key.cast("long"))


def item_key(item: Column, seed: int) -> Column:
    """A key of BITS bits from an integral item and a seed."""
    low = F.pmod(item.cast("long"), F.lit(1 << BITS))
    return F.pmod(low * MULTIPLIER + F.lit(seed), F.lit(1 << BITS))
