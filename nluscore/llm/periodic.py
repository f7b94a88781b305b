"""Periodic runs of words, found online by catchers of squares over completed power-of-two blocks.

Words are appended in portions of any size. A block is a stretch of 2^k words that starts at a multiple of
2^k; once its last word is there a catcher watches it for squares of period p, 2^(k+1) - 1 <= p <= 2^(k+2) - 2:
every stretch of 2^(k+1) - 1 words holds a whole block, so each square of such a period has one in its first
half. Where the block's words occur again p words later the catcher starts a suffix comparison. It reaches back to the
first word that differs from the word p later, and every appended word equal to the word p before it advances it.
A comparison as long as two periods has met a square; squares of one period merge into the run that the
comparison spans when it ends. Of runs with equal bounds that of the smallest period counts.

All catchers of a level work in one numpy step. Blocks are compared by 64-bit names, a name of 2^k words
made from those of its halves; every reported run is verified word by word, and names are drawn anew if one fails.

Texts of an Arrow batch are one stream, a word of its own between two texts, so that no run goes
beyond its text. Memory: about 8 bytes a word and level, for the larger of STREAM words and one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, need

#: Words that are searched together.
STREAM = 1 << 18

RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Level:
    """Catchers of one block length: names of all stretches that long, comparisons that still run."""

    def __init__(self, k: int):
        self.block, self.low, self.high = 1 << k, (2 << k) - 1, (4 << k) - 2
        self.names = np.zeros(0, np.uint64)
        self.live = np.zeros((0, 2), np.int64)  # period, start; all end at the last word
        self.done: list[np.ndarray] = []  # period, start, end

    def occurrences(self, before: int, n: int, most: int) -> np.ndarray:
        """(period, start) of blocks whose words occur again, the second time complete since ``before`` words."""
        b, high = self.block, min(self.high, most)
        names, out = self.names, []
        blocks = np.arange(max(0, -(-(before - high - 2 * b + 1) // b)) * b, n - self.low - b + 1, b)
        if not len(blocks) or high < self.low:
            return np.zeros((0, 2), np.int64)
        if high - self.low < len(blocks):
            for p in range(self.low, high + 1):
                s = blocks[np.searchsorted(blocks, before - p - b, side="right"):np.searchsorted(blocks, n - p - b, side="right")]
                s = s[names[s] == names[s + p]] if len(s) else s
                if len(s):
                    out.append(np.stack([np.full(len(s), p), s], axis=1))
        else:
            for s in blocks:
                p = np.arange(max(self.low, before - s - b + 1), min(high, n - s - b) + 1)
                p = p[names[s + p] == names[s]] if len(p) else p
                if len(p):
                    out.append(np.stack([p, np.full(len(p), s)], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


class Catchers:
    """Reads words online (:meth:`append`) and reports runs of at least two periods, periods up to ``most``."""

    def __init__(self, most: int, seed: int = 0):
        self.most, self.seed = most, np.uint64(seed)
        self.words = np.zeros(0, np.int64)
        self.levels: list[Level] = []
        while (2 << len(self.levels)) - 1 <= most:
            self.levels.append(Level(len(self.levels)))

    def _names(self, k: int) -> None:
        """Names of the stretches that the last words completed."""
        level, n = self.levels[k], len(self.words)
        have, total = len(level.names), max(0, n - level.block + 1)
        if k == 0:
            new = mixed(self.words[have:].astype(np.uint64) + mixed(self.seed + np.arange(1, 2, dtype=np.uint64)))
        else:
            half = self.levels[k - 1]
            left, right = half.names[have:total], half.names[have + half.block:total + half.block]
            new = mixed(left * np.uint64(0x9E3779B97F4A7C15) + mixed(right))
        level.names = np.concatenate([level.names, new]) if have else new

    def _forward(self, k: int, period: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``end`` moved on past every word equal to the word ``period`` before it, levels up to ``k``."""
        end = end.copy()
        for j in range(k, -1, -1):
            names, b = self.levels[j].names, self.levels[j].block
            at = np.arange(len(end))
            while len(at):  # the highest level may match many times, lower ones at most once
                at = at[end[at] < len(names)]
                at = at[names[end[at]] == names[end[at] - period[at]]]
                end[at] += b
                if j < k:
                    break
        return end

    def _back(self, k: int, period: np.ndarray, start: np.ndarray) -> np.ndarray:
        """``start`` moved back over every word equal to the word ``period`` after it: less than a block."""
        start = start.copy()
        for j in range(k - 1, -1, -1):
            names, b = self.levels[j].names, self.levels[j].block
            at = np.flatnonzero(start >= b)
            at = at[names[start[at] - b] == names[start[at] - b + period[at]]]
            start[at] -= b
        return start

    def append(self, words: np.ndarray) -> None:
        """Advances every comparison over ``words`` and starts those of blocks met again in them."""
        before = len(self.words)
        self.words = np.concatenate([self.words, words.astype(np.int64)])
        n = len(self.words)
        for k, level in enumerate(self.levels):
            self._names(k)
            period, start = level.live.T
            end = self._forward(k, period, np.full(len(period), before, np.int64))
            running = np.zeros((0, 3), np.int64)
            if len(period):
                running = np.stack([period, start, end], axis=1)
            met = level.occurrences(before, n, self.most)
            if len(met):
                # a comparison that runs has the block's occurrence already
                order = np.argsort(running[:, 0], kind="stable")
                known = running[order]
                at = np.searchsorted(known[:, 0], met[:, 0])
                has = at < len(known)
                has[has] = (known[at[has], 0] == met[has, 0]) & (known[at[has], 2] >= met[has].sum(axis=1) + level.block)
                met = met[~has]
            if len(met):
                # neighbouring blocks met again at one distance are one comparison
                met = met[np.lexsort((met[:, 1], met[:, 0]))]
                new = np.ones(len(met), bool)
                new[1:] = (met[1:, 0] != met[:-1, 0]) | (met[1:, 1] != met[:-1, 1] + level.block)
                first = met[new]
                last = met[np.append(np.flatnonzero(new)[1:], len(met)) - 1, 1]
                end = self._forward(k, first[:, 0], last + first[:, 0] + level.block)
                running = np.concatenate([running, np.stack([first[:, 0], self._back(k, *first.T), end], axis=1)])
            over = running[:, 2] < n
            level.live = running[~over, :2]
            level.done.append(running[over & (running[:, 2] - running[:, 1] >= 2 * running[:, 0])])

    def squares(self) -> np.ndarray:
        """(period, start, end) of all maximal stretches so far that hold a square of the period, smallest periods only."""
        n = len(self.words)
        rows = [x for level in self.levels for x in (*level.done, np.column_stack([level.live, np.full(len(level.live), n)]))]
        found = np.concatenate([np.zeros((0, 3), np.int64), *rows])
        found = found[found[:, 2] - found[:, 1] >= 2 * found[:, 0]]
        found = found[np.lexsort(found.T)]  # by end, start, period
        return found[np.append(True, (found[1:, 1:] != found[:-1, 1:]).any(axis=1))] if len(found) else found

    def exact(self, found: np.ndarray) -> bool:
        """Whether the words bear out every stretch: its period holds inside it and not one word beyond."""
        w, n = self.words, len(self.words)
        return all((w[a:b - p] == w[a + p:b]).all() and (a == 0 or w[a - 1] != w[a - 1 + p]) and (b == n or w[b] != w[b - p])
                   for p, a, b in found.tolist())


def runs_of(words: np.ndarray, most: int) -> np.ndarray:
    """(period, start, end) of every run in a stream of words, see :class:`Catchers`."""
    for seed in range(8):
        c = Catchers(most, seed)
        c.append(words)
        found = c.squares()
        if c.exact(found):
            return found
    raise RuntimeError("names of different stretches fell together eight times")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and the bounds of each text among them."""
    texts = pc.fill_null(texts, "")
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if off[-1] == off[0]:
        return pa.array([], pa.string()), np.zeros(len(off), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[off[0]:off[-1]]
    ink = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    edges = off[:-1][off[:-1] < off[-1]] - off[0]
    start[edges] = ink[edges]
    length = np.cumsum(np.append(0, ink))  # bytes of words before each byte
    at = np.flatnonzero(start)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(length[at], length[-1]).astype(np.int32)), pa.py_buffer(raw[ink].tobytes()))
    return words, np.searchsorted(at, off - off[0])


def collapse(texts: pa.Array, ids: list, least_length: int, least_exponent: int,
             rewrite: Callable[[object, int], tuple[int, int] | None] | None) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of every text."""
    words, bounds = words_of(texts)
    total, sizes = len(words), np.diff(bounds)
    order = np.arange(total)
    for k, i in enumerate(ids if rewrite else []):
        tail = rewrite(i, int(sizes[k]))
        if tail is not None:
            a, p = tail
            order[bounds[k] + a:bounds[k + 1]] = bounds[k] + a + np.arange(sizes[k] - a) % p
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
    stream = np.insert(codes, bounds[1:], total + np.arange(len(sizes)))
    found = runs_of(stream, int(sizes.max(initial=0)) // least_exponent)
    length = found[:, 2] - found[:, 1]
    found = found[(length >= least_length) & (length >= least_exponent * found[:, 0])]
    found = found[np.lexsort((found[:, 0], found[:, 1]))]
    text = np.searchsorted(bounds[1:] + np.arange(len(sizes)), found[:, 1], side="right")
    spoken = found[:, 1] - text  # places among all words, without those between texts
    drop = np.zeros(total + 1, np.int64)
    np.add.at(drop, spoken + found[:, 0], 1)
    np.add.at(drop, spoken + found[:, 2] - found[:, 1], -1)
    kept = np.cumsum(drop)[:-1] == 0
    ends = np.append(0, np.cumsum(kept))[bounds].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(order[kept]))), " ")
    rows = pa.StructArray.from_arrays([pa.array(spoken - bounds[text]), pa.array(found[:, 2] - found[:, 1]), pa.array(found[:, 0])], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32)), rows)
    return runs, collapsed


def portions(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about ``size`` bytes, one row at least."""
    n = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    k = 0
    while k < len(n):
        stop = max(k + 1, int(np.searchsorted(n, (n[k - 1] if k else 0) + size, side="right")))
        yield k, stop - k
        k = stop


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 6, least_exponent: int = 4,
                  rewrite: Callable[[object, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """(id, runs, collapsed) of every row: its runs of words as (start, length, period) by start, then period, and its words
    joined by one space, without those that a run contains after its first ``period`` words.

    A run is a stretch of words with smallest period q that no neighbouring word extends, at least ``least_length``
    words and ``least_exponent`` (2 or more) times q long. ``rewrite(id, number of words)`` may name (a, p): every word i >= a
    then becomes word a + (i - a) % p before the search. Null, empty and blank texts have no words, hence no
    runs and an empty collapsed text. Texts of any length are searched whole. Null and repeated ids and repeated rows give one
    result a row; runs that overlap or tie all count; an empty table gives none; extra columns take no part.
    """
    if least_exponent < 2:
        raise ValueError("a run holds a square: least_exponent is 2 or more")
    d = need(docs, id_col, text).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in portions(b.column("text"), STREAM * 6):
                part = b.slice(k, n)
                runs, collapsed = collapse(part.column("text"), part.column("id").to_pylist(), least_length, least_exponent, rewrite)
                yield pa.RecordBatch.from_arrays([part.column("id"), runs, collapsed], names=["id", "runs", "collapsed"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, {RUNS}")


def planted_tail(doc_id: object, n: int) -> tuple[int, int] | None:
    """The contract's rewrite: in a tenth of the texts, by the crc32 of the id, the last words repeat a period."""
    import zlib

    g, rest = divmod(zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), 10)
    if rest or not n:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def run_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_runs, the longest run (ties: smallest start, then period), digests of runs and words."""
    r = periodic_runs(docs, rewrite=planted_tail)
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", *(x[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    r = r.select("id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"))
    return r.select(F.col("id").alias("doc_id"), "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.period")).alias("period"),
                    F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
