"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

Training: windows around spans of the base patterns in a bounded sample of texts (WINDOWS of each kind, three times as many without
any, a tenth of those with numbers of other kinds put in) are the labelled spans; a rewritten copy of each window carries forms that the
patterns don't know (a bracketed "at", dotted cards, phones without a plus). The network learns on the driver in numpy.

Inference: a text of any length is cut into windows that overlap by half a window at most; windows of one length
are read together, each is decoded by the Viterbi path, and the windows of a text are reconciled: spans that an inner edge cut are joined
with the next window's or give way to its whole ones, and of spans that collide those of the greatest total log-odds against "no
personal data" stay. Windows in which no step could leave "none" with a gain need no decoding: the path of
"none" is best by a bound on every step. An exact check of the kind's digits follows; base spans always stay, and added spans never meet one.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import need
from .periodic import portions

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NUMBERS = {
    "ip": re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def small_parts(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start, then kind; linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _NUMBERS["ip"].finditer(text):
        if small_parts(m[0]):
            out.append((m.start(), 1, m.end()))
    for m in _NUMBERS["card"].finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _NUMBERS["phone"].finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- network -------------------------------------------------------------------------------------------------------------

#: Characters are told apart up to the case of letters and the value of digits; all beyond ASCII are one.
_FOLD = [ord(chr(c).lower()) if chr(c).isalpha() else ord("0") if chr(c).isdigit() else c for c in range(128)] + [128]
_CODE = {c: k for k, c in enumerate(sorted(set(_FOLD)))}
CLASS = np.array([_CODE[c] for c in _FOLD], np.uint8)
PAD = len(_CODE)
LABELS = len(KINDS) + 1

#: Cells a direction; characters of a training window; windows of each kind; texts whose spans are looked at, about.
CELLS, TRAIN, WINDOWS, TEXTS = 8, 64, 400, 4000
STEPS, BATCH, RATE = 640, 128, 0.02
#: Characters of a window, of its overlap with the next, windows read together, least log-odds of an added span.
SPAN, OVERLAP, TOGETHER, LEAST = 512, 48, 512, 0.0


def classes(text: str) -> np.ndarray:
    """The class of every code point."""
    return CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    """Weights: what a character adds to the gates of each direction (its embedding times the input weights), recurrent weights, emissions,
    CRF transitions, start and end. Gates are piecewise linear, the cell's squashing is x / (1 + |x|)."""

    NAMES = ("chars", "again", "emit", "bias", "move", "start", "end")

    def __init__(self, seed: int = 5, cells: int = CELLS):
        rng = np.random.default_rng(seed)
        self.cells = cells
        self.chars = rng.normal(0, 0.4, (2, PAD + 1, 4 * cells)).astype(np.float32)
        self.chars[:, :, cells:2 * cells] += 1
        self.again = rng.normal(0, 0.5 / np.sqrt(cells), (2, cells, 4 * cells)).astype(np.float32)
        self.emit = rng.normal(0, 0.3, (2 * cells, LABELS)).astype(np.float32)
        self.bias = np.zeros(LABELS, np.float32)
        self.move = np.zeros((LABELS, LABELS), np.float32)
        self.start, self.end = np.zeros(LABELS, np.float32), np.zeros(LABELS, np.float32)
        self.close_pad()

    def close_pad(self) -> None:
        """Padding shuts the input gate: a direction that begins in padding starts from zero."""
        self.chars[:, PAD] = 0
        self.chars[:, PAD, :self.cells] = -1e3

    def states(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, 2 x cells, window) for codes (time, window); ``keep`` gets what learning needs."""
        steps, many = codes.shape
        n = self.cells
        # a gate is clip(x / 4 + 1 / 2, 0, 1): its weights are scaled beforehand
        scale = np.repeat(np.array([0.25, 1], np.float32), [3 * n, n])[:, None]
        shift = np.repeat(np.array([0.5, 0], np.float32), [3 * n, n])[:, None]
        chars = [np.ascontiguousarray(t.T * scale + shift, np.float32) for t in self.chars]
        again = np.ascontiguousarray(self.again.transpose(0, 2, 1) * scale, np.float32)
        ahead, behind = codes.astype(np.intp), codes[::-1].astype(np.intp)
        h, c = np.zeros((2, n, many), np.float32), np.zeros((2, n, many), np.float32)
        z, more = np.empty((2, 4 * n, many), np.float32), np.empty((2, 4 * n, many), np.float32)
        out = np.empty((steps, 2 * n, many), np.float32)
        kept = []
        for s in range(steps):
            np.take(chars[0], ahead[s], axis=1, out=z[0], mode="clip")
            np.take(chars[1], behind[s], axis=1, out=z[1], mode="clip")
            np.matmul(again, h, out=more)
            z += more
            gates = z[:, :3 * n]
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            g = squash(z[:, 3 * n:])
            was = c
            c = z[:, n:2 * n] * c + z[:, :n] * g
            a = squash(c)
            before, h = h, z[:, 2 * n:3 * n] * a
            out[s, :n], out[steps - 1 - s, n:] = h[0], h[1]
            if keep is not None:
                kept.append((gates.copy(), g, was, c, a, before))
        if keep is not None:
            keep["rows"], keep["steps"] = np.stack([ahead, behind + PAD + 1], axis=1), kept
        return out

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, window, label); padding is no personal data."""
        x = self.states(codes, keep)
        e = np.ascontiguousarray(np.matmul(self.emit.T, x).transpose(0, 2, 1)) + self.bias
        none = codes == PAD
        if none.any():
            e[none] = [0] + [-1e4] * (LABELS - 1)
        if keep is not None:
            keep["x"], keep["none"] = x, none
        return e

    def paths(self, e: np.ndarray) -> np.ndarray:
        """Viterbi labels (time, window)."""
        steps = len(e)
        back = np.empty(e.shape, np.int8)
        v = self.start + e[0]
        for t in range(1, steps):
            w = v[:, :, None] + self.move
            back[t] = w.argmax(axis=1)
            v = np.take_along_axis(w, back[t][:, None, :].astype(np.intp), 1)[:, 0] + e[t]
        at = (v + self.end).argmax(axis=1)
        out = np.empty(e.shape[:2], np.int8)
        for t in range(steps - 1, -1, -1):
            out[t] = at
            at = back[t][np.arange(len(at)), at] if t else at
        return out

    def certain(self, e: np.ndarray) -> np.ndarray:
        """Windows whose best path is "none" throughout: no step, whatever the labels on its two sides, gains over it."""
        best = self.move.max(axis=0)
        least = e[..., 0] + self.move[0, 0]
        safe = (least[1:, :, None] >= e[1:, :, 1:] + best[1:]).all(axis=(0, 2)) & bool((self.move[0, 0] >= self.move[:, 0]).all() and (self.end[0] >= self.end).all())
        return safe & ((self.start[0] + e[0, :, :1]) >= self.start[1:] + e[0, :, 1:]).all(axis=1)

    def loss(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the labels (time, window), and gradients of all weights."""
        keep: dict = {}
        e = self.emissions(codes, keep).astype(np.float64)
        steps, many, _ = e.shape
        # forward and backward sums, each step's scaled to one
        move, first, last = (np.exp(w.astype(np.float64)) for w in (self.move, self.start, self.end))
        top = e.max(axis=2, keepdims=True)
        q = np.exp(e - top)
        ahead, behind, scale = np.empty_like(e), np.empty_like(e), np.empty((steps, many, 1))
        at = first * q[0]
        for t in range(steps):
            if t:
                at = (at @ move) * q[t]
            scale[t] = at.sum(axis=1, keepdims=True)
            at = at / scale[t]
            ahead[t] = at
        end = (at * last).sum(axis=1, keepdims=True)
        q /= scale
        at = last / end
        for t in range(steps - 1, -1, -1):
            behind[t] = at
            at = (q[t] * at) @ move.T
        z = np.log(end[:, 0]) + (np.log(scale) + top).sum(axis=(0, 2))
        p = ahead * behind
        y = np.eye(LABELS)[labels]
        pair = move * (ahead[:-1].reshape(-1, LABELS).T @ (q[1:] * behind[1:]).reshape(-1, LABELS))
        seen = y[:-1].reshape(-1, LABELS).T @ y[1:].reshape(-1, LABELS)
        path = (e * y).sum() + (self.move * seen).sum() + (y[0] @ self.start).sum() + (y[-1] @ self.end).sum()
        grad = {"move": (pair - seen) / many, "start": (p[0] - y[0]).sum(axis=0) / many, "end": (p[-1] - y[-1]).sum(axis=0) / many}
        de = ((p - y) / many).astype(np.float32)
        de[keep["none"]] = 0
        x, n = keep["x"], self.cells
        de = np.ascontiguousarray(de.transpose(0, 2, 1))
        grad["emit"], grad["bias"] = np.einsum("tnw,tlw->nl", x, de, optimize=True), de.sum(axis=(0, 2))
        dx = np.matmul(self.emit, de)
        dz = np.empty((steps, 2, 4 * n, many), np.float32)
        dc = np.zeros((2, n, many), np.float32)
        again = np.zeros_like(self.again)
        later = np.zeros((2, n, many), np.float32)
        for s in range(steps - 1, -1, -1):
            gates, g, was, c, a, before = keep["steps"][s]
            dh = np.stack([dx[s, :n], dx[steps - 1 - s, n:]]) + later
            dc = dc + dh * gates[:, 2 * n:] * (1 - np.abs(a)) ** 2
            d = dz[s]
            d[:, :n], d[:, n:2 * n], d[:, 2 * n:3 * n] = dc * g, dc * was, dh * a
            d[:, :3 * n] *= 0.25 * ((gates > 0) & (gates < 1))
            d[:, 3 * n:] = dc * gates[:, :n] * (1 - np.abs(g)) ** 2
            again += before @ d.swapaxes(1, 2)
            later = self.again @ d
            dc = dc * gates[:, n:2 * n]
        grad["again"] = again
        hot = np.zeros((steps * 2 * many, 2 * (PAD + 1)), np.float32)
        hot[np.arange(len(hot)), keep["rows"].reshape(-1)] = 1
        grad["chars"] = (hot.T @ dz.swapaxes(2, 3).reshape(-1, 4 * n)).reshape(self.chars.shape)
        return float((z.sum() - path) / many), grad

    def learn(self, codes: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 9) -> float:
        """Adam steps over shuffled windows (window, time), falling rate; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        second = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        step, mean = 0, 0.0
        while step < steps:
            order, losses = rng.permutation(len(codes)), []
            for k in range(0, len(order), BATCH):
                some = order[k:k + BATCH]
                loss, grad = self.loss(codes[some].T, labels[some].T)
                losses.append(loss)
                size = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grad.values()))
                step += 1
                rate = RATE * (1 - 0.95 * step / steps)
                for name, g in grad.items():
                    g = (g * min(1.0, 5 / max(size, 1e-9))).astype(np.float32)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    w = getattr(self, name)
                    w -= (rate * first[name] / (1 - 0.9 ** step) / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
                self.close_pad()
            mean = float(np.mean(losses))
        return mean


# ---- training windows ----------------------------------------------------------------------------------------------------

def training_windows(docs: DataFrame, id_col: str, text: str, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(window, spans inside it as start, end, label): at most WINDOWS distinct windows of each kind and 3 x WINDOWS without
    personal data, from about TEXTS texts with a digit or an @ and as many others, drawn by a hash of the id."""
    d = need(docs, id_col, text).toDF("id", "text").where(F.col("text").isNotNull())
    marked = F.col("text").rlike("[0-9@]")
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.xxhash64("text"), F.lit(seed)), F.lit(1 << 30))
    n = d.agg(F.count_if(marked).alias("yes"), F.count_if(~marked).alias("no")).first()

    def below(many: int) -> Column:
        return draw < min(1 << 30, (TEXTS << 30) // max(many, 1))

    some = d.where(F.when(marked, below(n["yes"])).otherwise(below(n["no"])))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, window, spans = [], [], []
            for t in b.column("text").to_pylist():
                found = base_spans(t)
                rng = np.random.default_rng(len(t))
                marks = [(f[1] + 1, (f[0] + f[2]) // 2) for f in found] + [(0, int(rng.integers(0, len(t) + 1)))]
                starts = np.array([f[0] for f in found])
                other = [m.start() for m in re.finditer(r"[0-9][^ \n]{5,}", t)]
                other = [o for o in other if not (k := int(np.searchsorted(starts, o, side="right"))) or found[k - 1][2] <= o]
                marks += [(0, o) for o in rng.permutation(other)[:4].tolist()]
                for label, mid in marks:
                    a = max(0, min(mid - int(rng.integers(8, TRAIN - 8)), len(t) - TRAIN))
                    inside = [(max(f[0] - a, 0), min(f[2] - a, TRAIN), f[1] + 1) for f in found if f[0] < a + TRAIN and f[2] > a]
                    if label or not inside:
                        kind.append(label), window.append(t[a:a + TRAIN]), spans.append([x for s in inside for x in s])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(window, pa.string()), pa.array(spans, pa.list_(pa.int32()))], names=["kind", "window", "spans"])

    w = some.select("text").mapInArrow(cut, "kind int, window string, spans array<int>").dropDuplicates(["kind", "window"])
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("window"), "window"))
    w = w.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("kind") == 0, 3 * WINDOWS).otherwise(WINDOWS))
    rows = w.orderBy("kind", "rank").collect()
    return [(r["window"], list(zip(r["spans"][::3], r["spans"][1::3], r["spans"][2::3]))) for r in rows]


def other_form(kind: int, s: str, rng: np.random.Generator) -> str:
    """The same data in a form that the base patterns don't know."""
    digits = "".join(c for c in s if c.isdigit())
    if kind == 1:
        at, dot = [("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), (" @ ", "."), ("(at)", ".")][rng.integers(7)]
        name, _, host = s.rpartition("@")
        return name + at + host.replace(".", dot)
    if kind == 2:
        return s.replace(".", ["[.]", "(.)", "[dot]", " . "][rng.integers(4)])
    if kind == 3:
        sep = [".", "_", "/", "  "][rng.integers(4)]
        return sep.join(digits[k:k + 4] for k in range(0, len(digits), 4))
    area, first, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"00{digits[:-10]} {area} {first}{last}", f"+{digits[:-10]}/{area}/{first}{last}",
            f"1-{area}-{first}-{last}", f"({area}) {first} {last}"][rng.integers(7)]


def other_number(rng: np.random.Generator) -> str:
    """A number that is no personal data."""
    shape = ["9", "99", "9999", "99999", "999999", "99999999", "9.9", "9.99", "9,999.99", "9999-99-99", "99.99.9999", "99:99:99", "v9.9.9", "9.9.9", "$9,999", "99%", "9999-9999",
             "#99999", "(9999)", "[9]", "9/99", "99/99/9999", "9e99", "x99a9f99", "a9b99c999d9e99f999", "999-9-99-999999-9", "@ 9", "@aaa", "+9", "+ 99", "+9.99", "9+9=99", "aa@aa", "9999 999", "9-9"]
    digit = lambda m: str(rng.integers(10))
    return re.sub("9", digit, shape[rng.integers(len(shape))])


def examples(windows: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(codes, labels), one row a window: the windows, rewritten copies of those with spans, a tenth of the others with numbers put in."""
    rng = np.random.default_rng(seed)
    texts = list(windows)
    for t, spans in windows:
        if spans:
            out, new, at = "", [], 0
            for a, b, kind in sorted(spans):
                whole = a > 0 and b < len(t) and a >= at
                out += t[at:a]
                form = other_form(kind, t[a:b], rng) if whole else t[a:b]
                new.append((len(out), len(out) + len(form), kind))
                out += form
                at = max(at, b)
            texts.append((out + t[at:], new))
        elif rng.random() < 0.6:
            k = int(rng.integers(0, len(t) + 1))
            k = t.rfind(" ", 0, k) + 1
            texts.append((t[:k] + other_number(rng) + (" " if k < len(t) else "") + t[k:], []))
    codes, labels = np.full((len(texts), TRAIN), PAD, np.uint8), np.zeros((len(texts), TRAIN), np.int8)
    for k, (t, spans) in enumerate(texts):
        c = classes(t)[:TRAIN]
        codes[k, :len(c)] = c
        for a, b, kind in spans:
            labels[k, a:b] = kind
    return codes, labels


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Network | None:
    """The network learned from base spans of a bounded sample; None when it holds none."""
    windows = training_windows(docs, id_col, text)
    if not any(s for _, s in windows):
        return None
    net = Network()
    net.learn(*examples(windows))
    return net


# ---- inference -----------------------------------------------------------------------------------------------------------

def window_spans(net: Network, texts: list[str]) -> dict[int, list[tuple[float, int, int, int, bool, bool]]]:
    """Per text: (log-odds, label, start, end, cut on the left, cut on the right) of the spans decoded in each window."""
    codes = classes("".join(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.append(0, np.cumsum(sizes))
    stride = SPAN - OVERLAP
    many = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - SPAN) // stride)), 0)
    text = np.repeat(np.arange(len(texts)), many)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * stride
    length = np.minimum(SPAN, sizes[text] - start)
    order = np.argsort(-length, kind="stable")
    out: dict[int, list] = {}
    flat = np.append(codes, PAD)
    for k in range(0, len(order), TOGETHER):
        some = order[k:k + TOGETHER]
        steps = np.arange(length[some[0]])
        at = first[text[some]] + start[some]
        batch = flat[np.where(steps[:, None] < length[some], at + steps[:, None], len(codes))]
        e = net.emissions(batch)
        open_ = np.flatnonzero(~net.certain(e))
        if not len(open_):
            continue
        e = e[:, open_]
        path = net.paths(e)
        for j, w in enumerate(some[open_]):
            labels = path[:length[w], j]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], labels, [0]])))
            for a, b in zip(edges, edges[1:]):
                if not labels[a]:
                    continue
                run, ej = labels[a:b], e[a:b, j]
                odds = (ej[np.arange(b - a), run] - ej[:, 0]).sum() + (b - a - 1) * (net.move[run[0], run[0]] - net.move[0, 0])
                odds += net.move[0, run[0]] - net.move[0, 0] if a else net.start[run[0]] - net.start[0]
                odds += net.move[run[0], 0] - net.move[0, 0] if b < len(labels) else net.end[run[0]] - net.end[0]
                left, right = a == 0 and start[w] > 0, b == length[w] and start[w] + b < sizes[text[w]]
                out.setdefault(int(text[w]), []).append((float(odds), int(run[0]), int(start[w] + a), int(start[w] + b), bool(left), bool(right)))
    return out


def joined(spans: list[tuple[float, int, int, int, bool, bool]]) -> list[tuple[float, int, int, int]]:
    """(log-odds, label, start, end) of one text's decoded spans, those that a window's edge cut joined with the next window's."""
    out: list[list] = []
    for odds, label, a, b, left, right in sorted(spans, key=lambda s: (s[2], s[3])):
        for j in out:
            if j[1] == label and j[4] and left and a <= j[3]:
                j[0], j[3], j[4] = max(j[0], odds), max(j[3], b), right
                break
        else:
            out.append([odds, label, a, b, right])
    return [tuple(j[:4]) for j in out]


def reconciled(spans: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """Of one text's spans those of greatest total log-odds of which no two overlap."""
    spans = sorted(spans, key=lambda s: (s[3], s[2]))
    ends = [s[3] for s in spans]
    totals, prior = [0.0], []  # best total of the first k spans; how many of them end before span k starts
    for k, s in enumerate(spans):
        prior.append(bisect.bisect_right(ends, s[2], 0, k))
        totals.append(max(totals[-1], totals[prior[-1]] + s[0]))
    out, k = [], len(spans)
    while k:
        if totals[k] > totals[k - 1]:
            out.append(spans[k - 1])
            k = prior[k - 1]
        else:
            k -= 1
    return out[::-1]


def plausible(kind: int, s: str) -> bool:
    """Exact check of an added span."""
    digits = re.sub(r"\D", "", s)
    if kind == 1:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(@|[\[(] ?(at|AT|At) ?[\])]) ?[A-Za-z0-9-]+( ?(\.|[\[(] ?(dot|DOT|Dot|\.) ?[\])]) ?[A-Za-z0-9-]+)+", s))
    if kind == 2:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and small_parts(".".join(parts)) and bool(re.fullmatch(r"[0-9]+( ?(\.|[\[(] ?(\.|dot) ?[\])]) ?[0-9]+){3}", s))
    if kind == 3:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9](?:[ ._/-]{0,2}[0-9])+", s))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[(]?[0-9][ ()./0-9-]+[0-9]", s))


def snapped(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """The span without white space and closing punctuation at its ends, then widened to whole words or numbers."""
    while a < b and text[a] in " \n\t":
        a += 1
    while b > a and text[b - 1] in " \n\t.,;":
        b -= 1
    if a < b:
        while a and text[a - 1].isascii() and (text[a - 1].isalnum() or kind == 1 and text[a - 1] in "._%+-"):
            a -= 1
        while b < len(text) and text[b].isascii() and text[b].isalnum():
            b += 1
    return a, b


def all_spans(net: Network | None, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """Per text (start, kind number, end, base) by start, then kind."""
    base = [base_spans(t) for t in texts]
    out = [[(*s, True) for s in b] for b in base]
    for k, spans in (window_spans(net, texts) if net is not None else {}).items():
        text = texts[k]
        free = []
        for odds, label, a, b in joined(spans):
            a, b = snapped(text, label, a, b)
            if odds > LEAST and not any(a < e and s < b for s, _, e in base[k]) and plausible(label, text[a:b]):
                free.append((odds, label, a, b))
        out[k] = sorted(out[k] + [(a, label - 1, b, False) for _, label, a, b in reconciled(free)])
    return out


SPANS = "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def personal_data(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) of every row: spans in code points, end exclusive, by start, then kind; ``base`` tells the patterns' spans
    from those that the network adds.

    Null texts count as empty; empty texts have no spans; texts of any length are read whole. Without a network only
    base spans come. Null and repeated ids and repeated rows give one result a row; spans of different kinds may overlap; an empty
    table gives no row; extra columns take no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    d = need(docs, id_col, text).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in portions(b.column("text"), 2 << 20):
                part = b.slice(k, n)
                found = all_spans(shared.value, [t or "" for t in part.column("text").to_pylist()])
                flat = [s for f in found for s in f]
                rows = pa.StructArray.from_arrays([pa.array([KINDS[s[1]] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int64()),
                                                   pa.array([s[2] for s in flat], pa.int64()), pa.array([s[3] for s in flat], pa.bool_())], names=["kind", "start", "end", "base"])
                bounds = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(bounds), rows)], names=["id", "spans"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, {SPANS}")


def pii_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, base spans of each kind counted, digest of the base spans, all spans as text."""
    p = personal_data(docs, train(docs))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    p = p.select("id", "spans", base.alias("base"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return p.select(F.col("id").alias("doc_id"), *map(number, KINDS), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
