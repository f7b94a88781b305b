"""Token tables and windows.

T1 is the only Python step: whitespace token offsets of all texts of an Arrow batch are found in one numpy
pass over their code points (Spark SQL has no prefix-scan over arrays). Everything after that is array
arithmetic in the JVM: a document's windows are built as structs with their own slices of the offsets and
exploded, so a window row never carries more than its window and the work is linear in the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.slices import in_slices
from .labels import IGNORED

# Python's str.isspace() set (the whitespace of str.split()); all of it lies at or below U+3000
_IS_WS = np.array([chr(i).isspace() for i in range(0x3002)])

OFFSETS_TYPE = T.StructType([T.StructField("starts", T.ArrayType(T.IntegerType())),
                             T.StructField("ends", T.ArrayType(T.IntegerType()))])


def word_edges(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whitespace tokens of all texts: (starts, ends) within their text, bounds of each text among the tokens, and each
    token's first code point."""
    codes = np.frombuffer("".join([(t or "") + " " for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.concatenate(([0], np.cumsum([len(t or "") + 1 for t in texts])))
    word = np.concatenate(([False], ~_IS_WS[np.minimum(codes, 0x3001)]))
    edge = np.flatnonzero(word[1:] != word[:-1])  # a space closes every text: edges come in pairs
    starts, ends = edge[::2], edge[1::2]
    bounds = np.searchsorted(starts, first)
    base = np.repeat(first[:-1], np.diff(bounds))
    return (starts - base).astype(np.int32), (ends - base).astype(np.int32), bounds, codes[starts]


@F.arrow_udf(OFFSETS_TYPE)
@in_slices
def token_offsets(text: pa.Array) -> pa.Array:
    """0-based ``[start, end)`` code-point offsets of whitespace-separated tokens."""
    starts, ends, bounds, _ = word_edges(text.to_pylist())
    none = pa.array(text.is_null())
    at = pa.array(bounds.astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x), mask=none if text.null_count else None) for x in (starts, ends)]
    return pa.StructArray.from_arrays(lists, names=["starts", "ends"])


def tokenize_offsets(df: DataFrame, text: str = "text", out_prefix: str = "") -> DataFrame:
    """Add ``starts``/``ends`` offset arrays and ``n_tokens``."""
    o = token_offsets(F.col(text))
    return (df.withColumn(f"{out_prefix}starts", o["starts"]).withColumn(f"{out_prefix}ends", o["ends"])
              .withColumn(f"{out_prefix}n_tokens", F.size(F.col(f"{out_prefix}starts"))))


def tokens_from_offsets(text: str = "text", starts: str = "starts", ends: str = "ends") -> Column:
    """Token strings from offsets (``substring`` counts code points like Python)."""
    return F.zip_with(F.col(starts), F.col(ends), lambda s, e: F.substring(F.col(text), s + 1, e - s))


def truncate(tokens: Column, max_len: int, model_max: int | None = None) -> Column:
    """Keep the first ``min(max_len, model_max)`` tokens."""
    n = min(max_len, model_max) if model_max else max_len
    return F.slice(tokens, 1, n)


def pair_lengths(first: Column, second: Column, max_len: int, strategy: str = "longest_first") -> Column:
    """T2 for a pair: struct(first, second, error) of the token counts that are kept of two counts, in closed form.

    ``longest_first`` cuts the longer side (of equal sides the second counts as the longer) to what the shorter leaves
    of ``max_len``; where that would make it the shorter one, both get half, the longer side the odd token. ``only_second`` /
    ``only_first`` cut one side alone; a side that would lose all its tokens can't be cut: the pair stays as it
    is, with ``error`` true. ``do_not_truncate`` keeps both.
    """
    a, b = first.cast("long"), second.cast("long")
    over = F.greatest(a + b - max_len, F.lit(0))
    no = F.lit(False)
    if strategy == "do_not_truncate":
        return F.struct(a.alias("first"), b.alias("second"), (over > 0).alias("error"))
    if strategy in ("only_first", "only_second"):
        cut, other = (a, b) if strategy == "only_first" else (b, a)
        fails = (over > 0) & (cut <= over)
        kept = F.when(fails, cut).otherwise(cut - over)
        one, two = (kept, other) if strategy == "only_first" else (other, kept)
        return F.struct(one.alias("first"), two.alias("second"), fails.alias("error"))
    if strategy != "longest_first":
        raise ValueError(f"unknown truncation strategy {strategy!r}")
    short = F.least(a, b)
    rest = F.greatest(short, max_len - short)
    halves = short + rest > max_len
    low = F.when(halves, F.lit(max_len // 2)).otherwise(short)
    high = F.when(halves, F.lit(max_len - max_len // 2)).otherwise(rest)
    one = F.when(over == 0, a).when(a > b, high).otherwise(low)
    two = F.when(over == 0, b).when(a > b, low).otherwise(high)
    return F.struct(one.cast("long").alias("first"), two.cast("long").alias("second"), no.alias("error"))


def truncate_pair(df: DataFrame, first: str, second: str, max_len: int, strategy: str = "longest_first", special: int = 0) -> DataFrame:
    """Cut two token arrays to ``max_len - special`` tokens together, see :func:`pair_lengths`; an uncuttable pair is
    kept whole (``truncation_error`` tells)."""
    n = pair_lengths(F.size(first), F.size(second), max_len - special, strategy)
    x = df.withColumn("_n", n)
    return (x.withColumn(first, F.slice(first, 1, F.col("_n.first").cast("int"))).withColumn(second, F.slice(second, 1, F.col("_n.second").cast("int")))
             .withColumn("truncation_error", F.col("_n.error")).drop("_n"))


def window_tokens(df: DataFrame, n_tokens: str, max_len: int, overlap: int, reserved: int = 0,
                  starts: str = "starts", ends: str = "ends", given: str | None = None) -> DataFrame:
    """Overlapping windows; ``overlap`` tokens are shared by consecutive windows (stride is the
    overlap, not the step); windows stop at the first one reaching the end.

    Adds ``window_id``, ``tok_start`` (inclusive) and ``tok_end`` (exclusive); ``starts`` and ``ends``, where
    there, become the window's own slices. ``given``: an array of structs with a ``window_id`` each, what is known of the
    text's windows; then a row is made per entry that names one of them, with the entry's other fields, in place of the array.
    """
    size = max_len - reserved
    step = size - overlap
    if size <= 0 or step <= 0:
        raise ValueError("max_len - reserved must exceed overlap")
    n = F.col(n_tokens)
    nw = 1 + F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    sliced = [c for c in (starts, ends) if c in df.columns]
    more = [f.name for f in df.schema[given].dataType.elementType if f.name != "window_id"] if given else []

    def made(i: Column, *fields: Column) -> Column:
        return F.struct(i.alias("window_id"), (i * step).cast("int").alias("tok_start"), F.least(i * step + size, n).cast("int").alias("tok_end"),
                        *(F.slice(F.col(c), i * step + 1, F.lit(size)).alias(c) for c in sliced), *fields)

    keep = [c for c in df.columns if c not in sliced and c != given]
    if given:
        own = F.filter(F.col(given), lambda g: g["window_id"] < nw)
        window = F.transform(own, lambda g: made(g["window_id"], *(g[c].alias(c) for c in more)))
        w = df.select(*keep, F.explode_outer(window).alias("_w")).filter(F.col("_w").isNotNull())
        return w.select(*keep, "_w.window_id", "_w.tok_start", "_w.tok_end", *(f"_w.{c}" for c in [*sliced, *more]))
    window = F.transform(F.sequence(F.lit(0), nw - 1), lambda i: made(i))
    # nw >= 1, so the outer form emits the same rows without an inferred size filter
    w = df.select(*keep, F.explode_outer(window).alias("_w"))
    return w.select(*keep, "_w.window_id", "_w.tok_start", "_w.tok_end", *(f"_w.{c}" for c in sliced))


def _own(offsets: str) -> Column:
    """The window's slice of an offset array: the array itself, or its part from ``tok_start`` where it is the whole text's."""
    n = F.col("tok_end") - F.col("tok_start")
    return F.when(F.size(offsets) > n, F.slice(offsets, F.col("tok_start") + 1, n)).otherwise(F.col(offsets))


def window_offsets(starts: str = "starts", ends: str = "ends", prefix: int = 1, suffix: int = 1) -> Column:
    """T4: per-window offset mapping: null for the ``prefix``/``suffix`` special (or question)
    positions, ``struct(start, end)`` for the window's context tokens."""
    ctx = F.arrays_zip(_own(starts).alias("start"), _own(ends).alias("end"))
    null = F.lit(None).cast("struct<start:int,end:int>")
    return F.concat(F.array_repeat(null, prefix), ctx, F.array_repeat(null, suffix))


def window_bounds(df: DataFrame, starts: str = "starts", ends: str = "ends") -> DataFrame:
    """Character span ``[char_start, char_end)`` of each window."""
    has = F.col("tok_end") > F.col("tok_start")
    return (df.withColumn("char_start", F.when(has, F.element_at(_own(starts), 1)))
              .withColumn("char_end", F.when(has, F.element_at(_own(ends), -1))))


def count_below(ascending: Column, value: Column, most: int, inclusive: bool) -> Column:
    """Elements of an ascending array of at most ``most`` elements that are below (or at) ``value``, by binary search."""
    steps = F.array(*(F.lit(1 << k) for k in range(max(1, most.bit_length()) - 1, -1, -1)))

    def further(at: Column, step: Column) -> Column:
        here = F.element_at(ascending, at + step)
        return F.when((at + step <= F.size(ascending)) & ((here <= value) if inclusive else (here < value)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def span_labels(windows: DataFrame, start_char: str, end_char: str, starts: str = "starts",
                ends: str = "ends", cls_index: int = 0, first_ctx_pos: int = 1, max_len: int = 512) -> DataFrame:
    """T5: answer start/end token positions inside each window; ``cls_index`` when the answer is
    absent or not fully inside the window (decision R18: only context tokens are scanned).

    Start = last context token starting at or before ``start_char``; end = first context token
    ending at or after ``end_char``, both by binary search over the window's slices (of at most ``max_len``
    tokens). Positions count from ``first_ctx_pos`` (after [CLS]).
    """
    ws, we = _own(starts), _own(ends)
    sc, ec = F.col(start_char), F.col(end_char)
    inside = (F.col("tok_end") > F.col("tok_start")) & sc.isNotNull() & \
        (F.element_at(ws, 1) <= sc) & (F.element_at(we, -1) >= ec)
    n_before_start = count_below(ws, sc, max_len, True)
    n_end_before = count_below(we, ec, max_len, False)
    return (windows.withColumn("start_position", F.when(inside, n_before_start - 1 + first_ctx_pos).otherwise(cls_index))
                   .withColumn("end_position", F.when(inside, n_end_before + first_ctx_pos).otherwise(cls_index)))


_PIECES_TYPE = T.StructType([T.StructField("word_id", T.ArrayType(T.IntegerType())),
                             T.StructField("piece", T.ArrayType(T.IntegerType())),
                             T.StructField("tag", T.ArrayType(T.StringType()))])


def _pieces_udf(piece_len: int):
    @F.arrow_udf(_PIECES_TYPE)
    @in_slices
    def pieces(words: pa.Array, tags: pa.Array) -> pa.Array:
        """Sub-token layout of a row, [CLS] and [SEP] included (word_id = piece = -1 there), of all rows at once."""
        n_words = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n_tags = pc.fill_null(pc.list_value_length(tags), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        lens = pc.fill_null(pc.utf8_length(words.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = np.maximum(-(-lens // piece_len), 1)
        word_at = np.cumsum(n_words) - n_words
        # every row: an edge, the pieces of its words, an edge
        upto = np.concatenate(([0], np.cumsum(parts)))
        pieces_of = upto[word_at + n_words] - upto[word_at]
        bounds = np.concatenate(([0], np.cumsum(pieces_of + 2)))
        inner = np.ones(bounds[-1], dtype=bool)
        inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
        word = np.repeat(np.arange(len(lens)), parts)
        row = np.repeat(np.arange(len(n_words)), n_words)
        word_id, piece, tag = (np.full(bounds[-1], -1, dtype=np.int64) for _ in range(3))
        own = np.arange(len(lens)) - word_at[row]
        word_id[inner] = own[word]
        piece[inner] = np.arange(len(word)) - upto[word]
        has = own < n_tags[row]
        tag[inner] = np.where(has, (np.cumsum(n_tags) - n_tags)[row] + own, -1)[word]
        at = pa.array(bounds.astype(np.int32))
        names = tags.flatten().take(pa.array(np.where(tag < 0, 0, tag), mask=tag < 0))
        cols = [pa.array(word_id.astype(np.int32)), pa.array(piece.astype(np.int32)), names]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, c) for c in cols], names=["word_id", "piece", "tag"])
    return pieces


def _with_ids(rows: DataFrame, tag: str, ids: DataFrame, most: int) -> DataFrame:
    """Rows left-joined with the ids of their tag. Most words share one tag ("O"), so rows never meet in a partition per tag:
    up to ``most`` ids are broadcast (counted), more are repeated for 64 numbers that rows take in turn."""
    if ids.count() <= most:
        return rows.join(F.broadcast(ids), tag, "left")
    ways = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_way")
    x = rows.withColumn("_way", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int"))
    return x.join(ids.select("*", ways), [tag, "_way"], "left").drop("_way")


def align_tags(df: DataFrame, words: str, tags: str, piece_len: int, vocab: DataFrame,
               b2i: DataFrame | None = None, broadcast_labels: int = 1_000_000) -> DataFrame:
    """Sub-token labels. Words are cut into pieces of ``piece_len`` characters between [CLS] and
    [SEP]; specials → -100; the first piece of a word → its tag id; other pieces → -100
    (``label_id``) or the tag's B→I id (``label_all_id``, L8).

    The piece layout of a row is one vectorised numpy step; the vocabulary is a counted broadcast up to
    ``broadcast_labels`` labels.
    Returns one row per sub-token: ``(..., pos, word_id, piece, label_id, label_all_id)``.
    """
    keep = [c for c in df.columns if c not in (words, tags)]
    x = df.withColumn("_p", _pieces_udf(piece_len)(F.col(words), F.col(tags)))
    z = F.arrays_zip(F.col("_p.word_id").alias("word_id"), F.col("_p.piece").alias("piece"), F.col("_p.tag").alias("tag"))
    # one generator over the helper's output (specials included): the helper runs once per row
    rows = x.select(*keep, F.posexplode_outer(z).alias("pos", "_t")).filter(F.col("_t").isNotNull())
    special = F.col("_t.word_id") < 0
    rows = rows.select(*keep, "pos", F.when(~special, F.col("_t.word_id")).alias("word_id"),
                       F.when(~special, F.col("_t.piece")).alias("piece"), F.col("_t.tag").alias("_tag"))
    v = (b2i if b2i is not None else vocab.withColumn("label_all_id", F.col("label_id")))
    v = v.select(F.col("label").alias("_tag"), F.col("label_id").alias("_id"), F.col("label_all_id").alias("_all"))
    y = _with_ids(rows, "_tag", v, broadcast_labels)
    lab = F.when(F.col("word_id").isNull(), F.lit(IGNORED)).when(F.col("piece") == 0, F.col("_id")).otherwise(F.lit(IGNORED))
    lab_all = F.when(F.col("word_id").isNull(), F.lit(IGNORED)).when(F.col("piece") == 0, F.col("_id")).otherwise(F.col("_all"))
    return y.select(*keep, "pos", "word_id", "piece", lab.cast("long").alias("label_id"),
                    lab_all.cast("long").alias("label_all_id"))
