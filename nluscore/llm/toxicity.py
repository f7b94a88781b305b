"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Lexicon terms (words and word beginnings) are gathered from all labelled rows: document counts per
   term, merged inside a batch and then by a partial aggregation, give candidates; those stay that are
   tied most to toxic rows by the number of different contexts, which copies of a text don't raise.
2. Each of the strongest terms is a voter; patterns over all terms are further voters. Voters vote
   toxic, clean or abstain.
3. The label model sees votes only. EM estimates each voter's accuracies given the hidden label; the
   voters' correlations given the label are estimated from what is left, and a voter correlated with
   others counts for less in the next round.
4. A logistic regression over the terms is trained on the posterior labels and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, need, release, stored

#: Bounds of the fit: labelled rows that the label model and the classifier see, terms kept, voters of one term. Least evidence
#: of a term: toxic rows (a number, not a share), ratio of rates, and nats by which its toxic share can't be chance.
FIT_ROWS, TERMS, VOTERS, LEAST_ROWS, LEAST_LIFT, LEAST_NATS = 12_000, 512, 48, 5, 5.0, 20.0
CANDIDATES = 16_384
#: Lengths of word beginnings; a word longer than LONGEST is known by its beginnings alone.
BEGINNINGS, LONGEST, KEEP_WORDS = (4, 5, 6, 7), 40, 400_000
PLAIN = str.maketrans("013457@$!", "oieastasi")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
ABSTAIN = -1


def terms_of(word: str) -> tuple[str, ...]:
    """Terms of one white-space word: the folded word (=...), its beginnings (^...), and whether signs hid it (*)."""
    w = EDGE.sub("", word.translate(PLAIN) if not word.isalpha() and any(c.isalpha() for c in word) else word)
    w = w or EDGE.sub("", word)
    out = ["=" + w] if 0 < len(w) <= LONGEST else []
    out += ["^" + w[:k] for k in BEGINNINGS if len(w) > k]
    return tuple(out)


class Terms:
    """Looks up a text's known terms; keeps what it found for words seen before, a bounded number."""

    def __init__(self, known: list[str]):
        self.index = {t: k for k, t in enumerate(known)}
        self.kept: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, int]:
        """(numbers of the text's terms, how often any occurs)."""
        kept, index, found = self.kept, self.index, Counter()
        words = text.lower().split()
        for w in words:
            got = kept.get(w)
            if got is None:
                if len(kept) >= KEEP_WORDS:
                    kept.clear()
                got = kept[w] = tuple(index[t] for t in terms_of(w) if t in index)
            if got:
                found[got] += 1
        return np.unique(np.array([i for g in found for i in g], np.int64)), sum(found.values())


def training_rows(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, text, y) of all labelled training rows, written once. A row labelled more than once is toxic if any label says so."""
    known = need(labels, id_col, label).where(train & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    texts = need(docs, id_col, text).where(train & F.col(text).isNotNull()).toDF("id", "text")
    # labels grow with the documents: a merge join at every size, whose hot ids adaptive execution splits
    out = stored(texts.join(known.hint("merge"), "id").select("id", "text", (F.col("y") > 0).cast("int").alias("y")), "labelled")
    release(docs.sparkSession)
    return out


def fit_rows(labelled: DataFrame, toxic: int, clean: int, rows: int = FIT_ROWS) -> DataFrame:
    """(text, y, w): about ``rows`` of the labelled rows, half of them toxic where there are as many, drawn by a hash.

    ``w``: rows that one stands for, so that a class drawn more densely doesn't count for more; repeated rows are one row
    that stands for all of them.
    """
    some = min(toxic, max(rows // 2, rows - clean))
    share = {1: min(1.0, some / max(1, toxic)), 0: min(1.0, (rows - some) / max(1, clean))}
    draw = F.pmod(F.xxhash64(F.lit("fit"), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    of = F.when(F.col("y") > 0, F.lit(share[1])).otherwise(F.lit(share[0]))
    drawn = labelled.where(draw < of).groupBy("id", "text", "y").agg(F.count("*").alias("n"))
    return stored(drawn.select("text", "y", (F.col("n") / of).alias("w")), "fit")


def lexicon(fit: DataFrame, all_t: int, all_c: int, terms: int = TERMS) -> list[str]:
    """Terms most tied to toxic rows, strongest first, by the z-score of their toxic share; ``fit``: all labelled rows, of which
    ``all_t`` are toxic and ``all_c`` clean."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256).to_pydict()
                for s, y in zip(part["text"], part["y"]):
                    seen[y > 0].update({t for w in set(s.lower().split()) for t in terms_of(w)})
                if len(seen[0]) + len(seen[1]) > 1 << 20:
                    yield emit(seen)
                    seen = (Counter(), Counter())
        yield emit(seen)

    def emit(seen) -> pa.RecordBatch:
        names = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][t] for t in names], pa.int64()),
                                           pa.array([seen[0][t] for t in names], pa.int64())], names=["term", "t", "c"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: k for k, t in enumerate(candidates)}
        for b in batches:
            found: set[tuple[int, str]] = set()
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256).to_pydict()
                for s in part["text"]:
                    before = ""
                    kept: dict[str, tuple[int, ...]] = {}
                    for w in s.lower().split():
                        if w not in kept:
                            kept[w] = tuple(index[t] for t in terms_of(w) if t in index)
                        for k in kept[w]:
                            found.add((k, before))
                        before = w
            cols = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string())], names=["k", "before"])

    if not all_t or not all_c:
        return []
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    lift = (t / (all_t + 1)) / (c / (all_c + 1))
    share, both = all_t / (all_t + all_c), F.col("t") + F.col("c")
    z = (F.col("t") - both * share) / F.sqrt(both * share * (1 - share))
    # the chance of so large a share is at most exp(-nats)
    own = F.col("t") / both
    nats = F.col("t") * F.log(own / share) + F.when(both > F.col("t"), (both - F.col("t")) * F.log((1 - own) / (1 - share))).otherwise(0.0)
    strong_enough = (F.col("t") >= LEAST_ROWS) & (lift >= LEAST_LIFT) & (nats >= LEAST_NATS)

    counted = fit.mapInArrow(count, "term string, t bigint, c bigint").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    first = counted.where(strong_enough).orderBy(F.desc(z), "term").limit(CANDIDATES).collect()
    candidates = [r["term"] for r in first]
    # Copies repeat a term with what stands before it: a term counts as often as it has different contexts.
    spread = fit.where("y > 0").mapInArrow(contexts, "k int, before string").distinct().groupBy("k").agg(F.count("*").alias("n"))
    known = fit.sparkSession.createDataFrame([(k, r["t"], r["c"]) for k, r in enumerate(first)], "k int, t bigint, c bigint")
    apart = spread.join(known, "k").withColumn("t", F.least("t", "n")).where(strong_enough)
    return [candidates[r["k"]] for r in apart.orderBy(F.desc(z), "k").limit(terms).collect()]


def votes(term_rows: list[tuple[np.ndarray, int]], voters: list[int], some: int) -> np.ndarray:
    """(rows, voters) of 1 toxic, 0 clean, -1 abstain: one column a lexicon voter, then the pattern voters."""
    v = np.full((len(term_rows), len(voters) + 4), ABSTAIN, np.int8)
    place = {t: k for k, t in enumerate(voters)}
    for r, (at, often) in enumerate(term_rows):
        for t in at.tolist():
            if t in place:
                v[r, place[t]] = 1
        v[r, -4] = 1 if len(at) else 0          # any term at all
        v[r, -3] = 1 if often >= 2 else ABSTAIN  # more than one occurrence
        v[r, -2] = 0 if often == 0 else ABSTAIN
        v[r, -1] = 1 if len(at) >= some else 0 if len(at) == 0 else ABSTAIN
    return v


def label_model(v: np.ndarray, prior: float, rounds: int = 40, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic a row, voters' outcome probabilities (voter, label, outcome), voters' weights); ``w``: weights of rows.

    EM over the hidden label with a fixed class prior. After every ten steps the voters' correlations
    given the label are taken from the residuals; a voter's say is divided by one plus the sum of their squares.
    """
    hot = np.stack([v == ABSTAIN, v == 0, v == 1], axis=2).astype(float)  # (row, voter, outcome)
    score = (v == 1).sum(axis=1) - (v == 0).sum(axis=1)
    post = np.where(score > 0, 0.9, 0.1 * prior)
    weight = np.ones(v.shape[1])
    w = np.ones(len(v)) if w is None else w
    for step in range(rounds):
        table = np.stack([np.einsum("r,rvo->vo", w * (1 - post), hot), np.einsum("r,rvo->vo", w * post, hot)], axis=1) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        if step % 10 == 9:
            signed = hot[:, :, 2] - hot[:, :, 1]
            mean = table[:, :, 2] - table[:, :, 1]
            left = signed - (np.outer(1 - post, mean[:, 0]) + np.outer(post, mean[:, 1]))
            sd = np.sqrt((w[:, None] * left ** 2).sum(axis=0) / w.sum()) + 1e-9
            rho = ((w[:, None] * left).T @ left) / w.sum() / np.outer(sd, sd)
            np.fill_diagonal(rho, 0)
            weight = 1 / (1 + (np.maximum(rho, 0) ** 2).sum(axis=1))
        ratio = np.log(table[:, 1]) - np.log(table[:, 0])  # (voter, outcome)
        say = np.einsum("rvo,vo->r", hot, ratio * weight[:, None]) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(say, -30, 30)))
    return post, table, weight


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 30, of: np.ndarray | None = None) -> np.ndarray:
    """Weights (last: intercept) of an L2 logistic regression on soft labels, by Newton steps; ``of``: weights of rows."""
    of = np.ones(len(x)) if of is None else of
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (of * (p - y)) + penalty * w
        hess = (x * (of * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text",
        label: str = "toxic") -> tuple[list[str], np.ndarray]:
    """(terms, weights) of the classifier; no terms when the labels hold one class only.

    The driver gets the terms and, of the bounded fit rows, which terms occur, never a text.
    """
    labelled = training_rows(docs, labels, train, id_col, text, label)
    n, toxic = (int(v or 0) for v in labelled.agg(F.count("*"), F.sum("y")).first())
    known = lexicon(labelled, toxic, n - toxic)
    if not known:
        return [], np.array([-4.0 if not toxic else float(np.log((toxic / n + 1e-3) / (1 - toxic / n + 1e-3)))])
    rows = fit_rows(labelled, toxic, n - toxic)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Terms(known)
        for b in batches:
            got = [look(s.as_py()) for s in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([g[0].tolist() for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.int64()), b.column("w")], names=["at", "often", "w"])

    seen = rows.mapInArrow(found, "at array<bigint>, often bigint, w double").toArrow()
    of = seen.column("w").to_numpy()
    of = of / of.mean()
    term_rows = [(np.array(a, np.int64), o) for a, o in zip(seen.column("at").to_pylist(), seen.column("often").to_pylist())]
    prior = float(np.clip(toxic / n, 1e-4, 0.99))
    # Voters: the strongest terms, one of those that mostly occur together.
    x = np.zeros((len(term_rows), len(known)))
    for r, (at, _) in enumerate(term_rows):
        x[r, at] = 1
    voters: list[int] = []
    for k in range(len(known)):
        both = x[:, voters].T @ x[:, k]
        either = x[:, voters].sum(axis=0) + x[:, k].sum() - both
        if len(voters) < VOTERS and (both < 0.7 * either).all():
            voters.append(k)
    post, _, _ = label_model(votes(term_rows, voters, 2), prior, w=of)
    return known, logistic(x, post, of=of)


def score(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row's whole text; null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = need(docs, id_col, text).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        look = Terms(known)
        for b in batches:
            z = np.array([w[look(s.as_py() or "")[0]].sum() for s in b.column("text")]) + w[-1] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "score"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document.

    Held out: crc32 of the id as text mod 4 is 2; labels of such rows are never read. predicted is 1 from a
    score of 0.3. Without labels of both classes every text gets the labels' base rate. Repeated rows, null texts (as empty
    ones) and very long texts are scored like any other, equal texts alike; empty documents give no row; extra
    columns take no part.
    """
    model = fit(docs, labels, crc_of_id(F.col(id_col)) % 4 != 2, id_col, text, label)
    s = score(docs, model, id_col, text)
    return s.select(F.col("id").alias("doc_id"), (crc_of_id(F.col("id")) % 4 == 2).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted"))
