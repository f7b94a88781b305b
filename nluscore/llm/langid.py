"""Language identification by cross-parsing entropy over suffix automata.

Per language, a suffix automaton of labelled text holds all its substrings. A text is parsed from
left to right into longest phrases that occur in that text: fewer phrases mean a closer language.
Phrase counts are normalised to bits a character, count * log2(training length) / characters, and
the language that needs fewest wins.

The automata are tables: one numpy gather moves many lanes one character ahead, and a missing
transition is stored as "phrase ends, go on from the root". Texts are cut into lanes of LANE
characters (a parse starts anew in each, for every language alike), so long texts cost no more a
character than short ones. No row is ever moved between tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, need, stored, tidy

#: Bounds of the training sample: rows a language, characters a language.
TRAIN_ROWS, TRAIN_CHARS = 64, 40_000
#: Characters of a lane, lanes read together, characters of a portion of texts.
LANE, LANES, STEP_CHARS = 512, 4096, 1 << 21


def _fold() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 32 for anything else (Basic Multilingual Plane)."""
    out = np.full(1 << 16, 32, np.int32)
    for k in range(1 << 16):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else k
    return out


_fold_table: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Folded code points: lower-case letters, other characters as single spaces, none at the ends."""
    if not _fold_table:
        _fold_table.append(_fold())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _fold_table[0][np.minimum(points, 0xFFFF)]
    for k in np.nonzero(points > 0xFFFF)[0]:
        low[k] = int(points[k]) if chr(points[k]).isalpha() else 32
    space = low == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    low = low[keep]
    return low[:-1] if len(low) and low[-1] == 32 else low


class Automaton:
    """Suffix automaton of one training text as a table (state x alphabet) of next states.

    Entries are state * width; entries with END set end a phrase and continue from the root.
    """

    END = np.uint32(1 << 31)

    def __init__(self, points: np.ndarray, code: dict[int, int]):
        trans, link, length, last = [{}], [-1], [0], 0
        for c in (code[p] for p in points.tolist()):
            new = len(trans)
            trans.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in trans[p]:
                trans[p][c] = new
                p = link[p]
            if p >= 0:
                q = trans[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(trans)
                    trans.append(dict(trans[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and trans[p].get(c) == q:
                        trans[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.width, self.size = len(code) + 1, len(points)
        # A character the language doesn't have (column 0: no language has it) is a phrase of its own: the
        # last state, which any character leaves with a new phrase. Nothing ends at the start.
        root = np.full(self.width, len(trans) * self.width, np.uint32)
        for c, q in trans[0].items():
            root[c] = q * self.width
        table = np.tile(root | self.END, (len(trans) + 1, 1))
        table[0] = root
        for s, row in enumerate(trans):
            for c, q in row.items():
                table[s, c] = q * self.width
        self.table = table.reshape(-1)

    def phrases(self, lanes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each lane. lanes: (characters, lanes) of codes; sizes: characters of each lane, falling.

        A lane's last, open phrase counts as a phrase; its first starts without one being ended.
        """
        steps, n = lanes.shape
        state, count = np.zeros(n, np.uint32), np.zeros(n, np.int32)
        mask, flag = np.uint32((1 << 31) - 1), np.uint32(31)
        alive = n
        for k in range(steps):
            while alive and sizes[alive - 1] <= k:
                alive -= 1
            if not alive:
                break
            s = state[:alive]
            s += lanes[k, :alive]
            got = self.table.take(s)
            count[:alive] += (got >> flag).astype(np.int32)
            np.bitwise_and(got, mask, out=s)
        return count + (sizes > 0)


class Model:
    """Automata of all languages over one alphabet."""

    def __init__(self, texts: dict[str, np.ndarray]):
        points = np.unique(np.concatenate(list(texts.values()))) if texts else np.zeros(0, np.int32)
        self.code = {int(p): k + 1 for k, p in enumerate(points)}
        self.points = points
        self.langs = sorted(texts)
        self.automata = [Automaton(texts[k], self.code) for k in self.langs]

    def codes(self, folded: np.ndarray) -> np.ndarray:
        if not len(self.points):
            return np.zeros(len(folded), np.int32)
        at = np.minimum(np.searchsorted(self.points, folded), len(self.points) - 1)
        return np.where(self.points[at] == folded, at + 1, 0).astype(np.int32)

    def bits(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits a character, (text, language), of folded non-empty texts."""
        owner, parts = [], []
        for k, t in enumerate(texts):
            for lo in range(0, len(t), LANE):
                owner.append(k)
                parts.append(t[lo:lo + LANE])
        sizes = np.array([len(p) for p in parts])
        order = np.argsort(-sizes, kind="stable")
        kind = np.uint8 if len(self.points) < 255 else np.uint16 if len(self.points) < 65535 else np.uint32
        phrases = np.zeros((len(texts), len(self.langs)))
        for lo in range(0, len(order), LANES):
            some = order[lo:lo + LANES]
            size = sizes[some]
            rows = np.zeros((len(some), size[0]), kind)
            rows[np.arange(size[0]) < size[:, None]] = self.codes(np.concatenate([parts[i] for i in some]))
            lanes = np.ascontiguousarray(rows.T)
            who = np.array([owner[i] for i in some])
            for k, a in enumerate(self.automata):
                phrases[:, k] += np.bincount(who, a.phrases(lanes, size), len(texts))
        bits = np.array([math.log2(max(2, a.size)) for a in self.automata])
        return phrases * bits / np.array([len(t) for t in texts], float)[:, None]


def stretches(t: str, draw: int, share: int) -> np.ndarray:
    """Folded letters of a text: all, or of a long one four stretches of ``share`` at places drawn by ``draw``."""
    folded = letters(t)
    if len(folded) <= 4 * share:
        return folded
    places = np.random.default_rng(draw & ((1 << 63) - 1)).integers(0, len(folded) - share + 1, 4)
    return np.concatenate([np.append(folded[k:k + share], 32) for k in places])


def training_texts(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text", id_col: str = "doc_id",
                   rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> dict[str, np.ndarray]:
    """At most ``chars`` folded characters a language, drawn from ``rows`` of its distinct texts with a letter.

    Of each language the texts with the lowest hashes are picked; a long text gives stretches at hashed
    places, all of it being read. Languages are picked each for itself. The driver receives languages x 4 x chars
    characters at most.
    """
    d = docs.where(train & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    d = d.select("lang", "text", F.xxhash64(F.lit("train"), "text").alias("draw"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    # a written table: its size is known before the texts are read again, so they are not shuffled
    picked = stored(d.select("lang", "draw").distinct().withColumn("rank", rank).where(F.col("rank") <= rows).select("lang", "draw"), "training-rows")
    share = max(1, chars // rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [stretches(t.as_py(), k, share) for t, k in zip(b.column("text"), b.column("draw").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("draw"), pa.array([g.astype("<i4").tobytes() for g in got], pa.binary())], names=["lang", "draw", "folded"])

    same = d.join(picked, ["lang", "draw"]).dropDuplicates(["lang", "draw"]).select("lang", "draw", "text")
    parts: dict[str, list] = {}
    for k, _, folded in same.mapInArrow(cut, "lang string, draw bigint, folded binary").orderBy("lang", "draw").collect():
        parts.setdefault(k, []).append(np.frombuffer(folded, "<i4"))
    texts = {}
    for k, some in parts.items():
        # the characters are spread over all texts: those that are shorter than an even share leave theirs to the others
        left, each = chars, 0
        for n, size in enumerate(sorted(len(x) for x in some)):
            each = max(1, left // (len(some) - n))
            left -= min(size, each)
        joined = np.concatenate([np.append(x[:each], 32) for x in some])[:chars]
        if (joined != 32).any():
            texts[k] = joined.astype(np.int32)
    return texts


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus lang_pred and score of every row.

    ``und`` with score 0 for a text that is null or has no letter, or when nothing was learned. Score:
    1 - bits of the best language / bits of the runner-up, stretched to 0..1 (0.5 is a tie); with one
    language learned it is 1. Ties go to the language first in code point order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    d = need(docs, *keep, *(() if text in keep else (text,)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(text)
            pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            at, some, chars = [], [], 0
            for i in range(b.num_rows + 1):
                if i == b.num_rows or chars > STEP_CHARS:
                    if at and m.langs:
                        bits = m.bits(some)
                        best = bits.argmin(axis=1)
                        low = bits[np.arange(len(at)), best]
                        bits[np.arange(len(at)), best] = np.inf
                        nxt = bits.min(axis=1)
                        sure = np.where(np.isinf(nxt), 1.0, 0.5 + 0.5 * (1 - low / np.maximum(nxt, 1e-12)))
                        score[at] = np.clip(sure, 0, 1)
                        for j, k in zip(at, best):
                            pred[j] = m.langs[k]
                    at, some, chars = [], [], 0
                if i < b.num_rows:
                    t = texts[i].as_py()
                    folded = letters(t) if t else ()
                    if len(folded):
                        at.append(i)
                        some.append(folded)
                        chars += len(folded)
            kept = [b.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([d.schema[k] for k in keep] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return d.mapInArrow(tidy(run), schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row; learned from rows not held out.

    Held out: crc32 of the id as text mod 3 is 1. Null ids count as the empty id. Text, and of the
    training rows the label, are all that a prediction rests on. Null texts and texts without a letter are ``und``; very
    long texts are parsed whole; repeated rows get the same result, an empty table none; without labelled training
    rows every text is ``und``; equal phrase counts go to the first language; extra columns take no part.
    """
    held = crc_of_id(F.col(id_col)) % 3 == 1
    model = Model(training_texts(docs, ~held, lang, text, id_col))
    out = identify(docs, model, text, (id_col,))
    return out.select(F.col(id_col).alias("doc_id"), (crc_of_id(F.col(id_col)) % 3 == 1).alias("held_out"), "lang_pred", "score")
