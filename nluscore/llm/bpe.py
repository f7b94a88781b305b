"""Byte-level BPE through a distinct-word table, and its decoding through an id-to-piece join.

A word is a stretch without white space with the one space before it; other white space forms words
of its own (:func:`words`). The tokenizer's own pre-tokenizer never joins characters of two such
words, so a text's ids are its words' ids in order.

Plan: (1) words are split and counted; counts are merged inside each Arrow batch, then by a partial
aggregation; (2) every distinct word is encoded once: words that occur twice or more in the word
table, a word that occurs once at its only place; (3) the most frequent words, at most
``hot_words`` of them, are broadcast; a text's other words are shuffled to the word table as
(text key, word) and come back as one list per text; (4) the texts, Zstandard-compressed for the
shuffle, meet that list and take ids by position; (5) ids are decoded by a join with the
vocabulary's id-to-piece table.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, need, release, stored, tidy

#: Words in the broadcast table, and bytes a word of it may have: bounds the broadcast (about 20 MB).
HOT_WORDS, HOT_BYTES = 1 << 19, 40

#: Unicode White_Space, which the pre-tokenizer's pattern calls \s.
WHITE = "\t-\r \x85\xa0  -     　"

#: Bytes of text whose words are counted together, and are looked up together: bounds a task's arrays.
COUNT_BYTES, JOIN_BYTES = 1 << 24, 1 << 22

_tokenizers: dict[str, "Bpe"] = {}


class Bpe:
    """A tokenizer file with its word rule and id-to-piece table; one per process and path."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        special = "|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)"
        self.special = re.compile(special)
        self.added = added
        #: ids in tables take two bytes where the vocabulary allows
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        #: a space between white space, or between white space and the end: a run that a plain cut would divide
        self.uneven = re.compile(rf" (?<=[{WHITE}] )(?=[{WHITE}]|\Z)")
        self.uneven_re2 = rf"[{WHITE}] ([{WHITE}]|\z)"
        self.rule = re.compile(
            rf"{special}|[{WHITE}]+(?=\Z|{special})| ?(?:(?!{special})[^{WHITE}])+|[{WHITE}]+(?=[{WHITE}])|[{WHITE}]")

    def words(self, text: str) -> list[str]:
        """The text cut into words whose concatenation it is and whose ids are its ids."""
        if "\0" in text or any(a in text for a in self.added) or self.uneven.search(text):
            return self.rule.findall(text)
        out = text.replace(" ", "\0 ").split("\0")
        return out if out[0] else out[1:]

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of many texts in order, as slices of their bytes, and the bounds of each text among them.

        Most texts are cut before every space; those with added tokens or white space that a cut would
        divide follow :func:`words`.
        """
        texts = pc.fill_null(texts, "")
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        if off[-1] == off[0]:
            return pa.array([], pa.string()), np.zeros(len(off), np.int64)
        start = np.frombuffer(texts.buffers()[2], np.uint8)[off[0]:off[-1]] == 32
        at = off.astype(np.int64) - off[0]
        start[at[:-1][at[:-1] < at[1:]]] = True
        odd = pc.match_substring_regex(texts, self.uneven_re2)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            sizes = [len(w.encode()) for w in self.words(texts[int(k)].as_py())]
            start[at[k]:at[k + 1]] = False
            start[at[k] + np.cumsum([0, *sizes[:-1]])] = True
        cut = np.append(np.flatnonzero(start), at[-1])
        words = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer((cut + off[0]).astype(np.int32)), texts.buffers()[2])
        return words, np.searchsorted(cut, at)

    def encode(self, words: list[str]) -> list[bytes]:
        """Each word's ids as bytes of ``dtype``."""
        out, kind = [], "H" if self.dtype.itemsize == 2 else "I"
        for k in range(0, len(words), 4096):
            out += [array(kind, e.ids).tobytes() for e in self.tok.encode_batch_fast(words[k:k + 4096], add_special_tokens=False)]
        return out

    def encoded(self, words: list[str]) -> pa.Array:
        """Each word's ids as bytes of ``dtype``, one flat Arrow array."""
        sizes, ids = [np.zeros(1, np.int64)], []
        for k in range(0, len(words), 4096):
            some = [e.ids for e in self.tok.encode_batch_fast(words[k:k + 4096], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, some), np.int64, len(some)))
            ids.append(np.fromiter(chain.from_iterable(some), self.dtype, int(sizes[-1].sum())))
        ends = np.cumsum(np.concatenate(sizes)) * self.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate(ids).tobytes() if ids else b"")])

    def pieces(self) -> list[bytes]:
        """The bytes of every id, in id order (byte-level alphabet; added tokens as they are)."""
        if not hasattr(self, "_pieces"):
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in set(printable)]
            byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
            vocab = self.tok.get_vocab(with_added_tokens=True)
            self._pieces = [b""] * (max(vocab.values()) + 1)
            for piece, i in vocab.items():
                self._pieces[i] = piece.encode() if piece in self.added else bytes(byte[c] for c in piece)
        return self._pieces

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Texts of the ids between each two bounds, in UTF-8, through the id-to-piece table."""
        if not hasattr(self, "_piece_table"):
            self._piece_table = pa.array(self.pieces(), pa.binary())
        body = self._piece_table.take(pa.array(ids))
        if not len(ids):
            return [b""] * (len(bounds) - 1)
        at, data = np.frombuffer(body.buffers()[1], np.int32)[bounds].tolist(), memoryview(body.buffers()[2])
        return [str(data[i:j], "utf-8", "replace").encode() for i, j in zip(at, at[1:])]


def bpe(path: str) -> Bpe:
    if path not in _tokenizers:
        _tokenizers[path] = Bpe(path)
    return _tokenizers[path]


def _parts(batch: pa.RecordBatch, size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices whose column ``name`` has about ``size`` bytes; a longer value is a slice of its own."""
    lo = total = 0
    for hi, n in enumerate(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy().tolist()):
        if hi > lo and total + n > size:
            yield batch.slice(lo, hi - lo)
            lo, total = hi, 0
        total += n
    if batch.num_rows > lo:
        yield batch.slice(lo)


def _listed(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _pairs(part: pa.RecordBatch) -> dict[str, bytes]:
    """Word to ids of all lists in the columns words and ids."""
    return dict(zip(_listed(part.column("words").flatten()), _listed(part.column("ids").flatten())))


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every distinct word that all texts hold more than once, and how often: (word, n)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bpe(path)
        for b in batches:
            for part in _parts(b, COUNT_BYTES):
                seen = t.split(part.column("text"))[0].value_counts()
                yield pa.RecordBatch.from_arrays(seen.flatten(), names=["word", "n"])

    counted = need(docs, text).select(F.col(text).alias("text")).mapInArrow(tidy(count), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) of (word, n)."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), t.encoded(_listed(b.column("word")))], names=["word", "n", "ids"])

    return words.mapInArrow(tidy(encode), "word string, n bigint, ids binary")


def word_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every distinct word that all texts hold more than once: (word, n, ids), written to the shared folder."""
    return stored(encoded_words(word_counts(docs, path, text), path), "words")


def most_frequent(words: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """The most frequent short words, at most ``hot_words``: all words from a count upward that fits."""
    short = words.where(F.octet_length("word") <= HOT_BYTES)
    # Counts by number of words: powers of two bound the rows; below a power the step is exact.
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = {r[0]: r[1] for r in short.groupBy(step.alias("s")).agg(F.count("*")).collect()}
    total, least = 0, None
    for s in sorted(steps, reverse=True):
        if total + steps[s] > hot_words:
            break
        total, least = total + steps[s], s
    return short.where(F.lit(False) if least is None else step >= least)


def hot_table(words: DataFrame) -> tuple[pa.Array, pa.Array]:
    """The words and their ids as two flat Arrow arrays, a fifth of what a Python dictionary of them takes in every worker."""
    got = words.select("word", "ids").toArrow().combine_chunks()
    return tuple(pa.concat_arrays(got.column(k).chunks).cast(t) if got.num_rows else pa.array([], t) for k, t in enumerate((pa.string(), pa.binary())))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text",
                  hot_words: int = HOT_WORDS, full: bool = False) -> DataFrame:
    """Ids of every text and the text decoded from them, one row per input row.

    (doc_id, n_tokens, ids_sha256, decoded_sha256); with ``full`` also ids (binary, little-endian
    unsigned 32-bit) and decoded. Null texts count as empty and have no ids. Repeated rows are
    encoded alike. Special tokens' strings in a text become their ids, as the library does.
    """
    import zstandard

    spark = docs.sparkSession
    words = word_table(docs, path, text)
    hot = spark.sparkContext.broadcast(hot_table(most_frequent(words, hot_words)))
    release(spark)
    # A key names a text; should two texts share one, both get the words of both, which harms neither.
    rows = need(docs, id_col, text).select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumn("key", F.xxhash64("id", "text"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = bpe(path), hot.value[0]
        for b in batches:
            for part in _parts(b, JOIN_BYTES):
                found, bounds = t.split(part.column("text"))
                found = found.dictionary_encode()
                unknown = pc.is_null(pc.index_in(found.dictionary, value_set=known)).to_numpy(zero_copy_only=False)
                at = found.indices.to_numpy()
                here = np.flatnonzero(unknown[at])
                # each text's unknown words once: (row, word) as one number
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))[here]
                row, word = np.divmod(np.unique(row * len(unknown) + at[here]), max(1, len(unknown)))
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), found.dictionary.take(pa.array(word))], names=["key", "word"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for part in _parts(b, JOIN_BYTES):
                body = [z.compress(s or b"") for s in _listed(part.column("text").cast(pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(body, pa.binary())], names=["id", "key", "body"])

    def by_position(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, z = bpe(path), zstandard.ZstdDecompressor()
        for b in batches:
            for some in _parts(b, JOIN_BYTES, "body"):  # compressed bytes
                texts, lo, size = [], 0, 0
                for hi, body in enumerate(_listed(some.column("body")), 1):
                    texts.append(z.decompress(body))
                    size += len(texts[-1])
                    if hi == some.num_rows or size > JOIN_BYTES:
                        yield together(t, some.slice(lo, hi - lo), pa.array(texts, pa.binary()).cast(pa.string(), safe=False))
                        texts, lo, size = [], hi, 0

    def together(t: Bpe, part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        """Results of some texts: each word they hold is looked up, or encoded here, once for all of them."""
        found, bounds = t.split(texts)
        found = found.dictionary_encode()
        known, known_ids = hot.value
        ids = known_ids.take(pc.index_in(found.dictionary, value_set=known))
        if ids.null_count:
            left = pc.is_null(ids)
            rest, own = _listed(found.dictionary.filter(left)), _pairs(part)
            got = [own.get(w) for w in rest]
            once = [k for k, x in enumerate(got) if x is None]
            for k, x in zip(once, t.encode([rest[k] for k in once])):
                got[k] = x
            ids = pc.replace_with_mask(ids, left, pa.array(got, pa.binary()))
        flat = ids.take(found.indices)
        if len(flat):
            bounds = np.frombuffer(flat.buffers()[1], np.int32)[bounds] // t.dtype.itemsize
            at = np.frombuffer(flat.buffers()[2], t.dtype, count=int(bounds[-1]))
        else:
            at = np.zeros(0, t.dtype)
        back, wide, ends = t.decode(at, bounds), at.astype("<u4"), bounds.tolist()
        wide = [wide[i:j].tobytes() for i, j in zip(ends, ends[1:])]
        sha = lambda values: [hashlib.sha256(v).hexdigest() for v in values]
        cols = [pa.array(np.diff(bounds), pa.int64()), pa.array(sha(wide)), pa.array(sha(back))]
        if full:
            cols += [pa.array(wide, pa.binary()), pa.array(back, pa.binary()).cast(pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        return pa.RecordBatch.from_arrays([part.column("id"), *cols], names=names[:len(cols) + 1])

    kind = rows.schema["id"].dataType.simpleString()
    wanted = rows.select("key", "text").mapInArrow(tidy(rare), "key bigint, word string")
    own = stored(wanted.join(words.select("word", "ids"), "word").groupBy("key").agg(F.collect_list(F.struct("word", "ids")).alias("own"))
                 .select("key", F.col("own.word").alias("words"), F.col("own.ids").alias("ids")), "own")
    discard(words)
    release(spark)
    bodies = rows.mapInArrow(tidy(packed), f"id {kind}, key bigint, body binary")
    out = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * full
    return bodies.join(own, "key", "left").select("id", "body", "words", "ids").mapInArrow(tidy(by_position), out)
