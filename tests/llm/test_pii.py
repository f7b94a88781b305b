"""Personal data: base patterns against plain regular expressions, the network's learning and decoding against
enumeration and differences, held-out accuracy, whole query."""

import hashlib
import itertools
import re

import numpy as np
import pytest

from nluscore.llm import pii
from nluscore.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
CASES = ["", "a@b", "a@b.c", "x.y+z@mail4.example.com, b@c.d@e.f", "@@a@b.co..", "é@x.de a.b@x.de.", "a@b.com.%x@c.de", "1.2.3.4.5.6.7.8", "999.1.2.3.4.5", "256.1.1.1 0255.1.1.1",
         "1.2.3", "..1.2.3.4..", "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111111111111112", "12 34 5678 9012 3456 7890 1234", "0" * 14, "+1 (017) 555-7713", "+1 (017) 555-77",
         "+12345678901234567", "+1+1 234 567 8901", "++49 30 1234567-", "+1 .... 234567890 ", "me@1.2.3.4 +1.2.3.4.5.6.7.8.9.0", "a" * 3000 + "@" + "b" * 10, "1" * 5000, "1." * 500, "日本 a@b.cd 日本 +81 3 1234 5678"]


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(digits[::-1])) % 10 == 0,
                  "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(1)
    made = ["".join(rng.choice(list("a1.@+- ()2é"), rng.integers(0, 60))) for _ in range(4000)]
    made += [" ".join(rng.choice(["+1 (017) 555-7713", "4111 1111 1111 1111", "1.2.3.4", "a.b@c.de", ",", "@", "+", "7"], 12)) for _ in range(300)]
    for t in CASES + made:
        assert pii.base_spans(t) == plain(t), t


def tiny(seed=1):
    net = pii.Network(seed, 3)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    rng = np.random.default_rng(seed)
    net.move, net.start, net.end = rng.normal(size=(5, 5)), rng.normal(size=5), rng.normal(size=5)
    return net, rng


def score(net, e, y):
    return net.start[y[0]] + sum(e[t, y[t]] for t in range(len(y))) + sum(net.move[a, b] for a, b in zip(y, y[1:])) + net.end[y[-1]]


def test_paths_loss_and_certainty_equal_enumeration():
    for seed in range(6):
        net, rng = tiny(seed)
        if seed > 2:
            net.move[0, 0], net.move[1:, 0], net.end[0], net.start[0] = 3, 2.9, 2, 2
        codes = rng.integers(0, pii.PAD, (4, 3))
        e = net.emissions(codes) + np.array([seed, 0, 0, 0, 0])
        paths, sure = net.paths(e), net.certain(e)
        for j in range(3):
            best = max(itertools.product(range(5), repeat=4), key=lambda y: score(net, e[:, j], y))
            assert tuple(paths[:, j]) == best and (not sure[j] or best == (0, 0, 0, 0))
        labels = rng.integers(0, 5, (4, 3))
        e = net.emissions(codes)
        z = [np.log(sum(np.exp(score(net, e[:, j], y)) for y in itertools.product(range(5), repeat=4))) for j in range(3)]
        want = np.mean([z[j] - score(net, e[:, j], labels[:, j]) for j in range(3)])
        assert abs(net.loss(codes, labels)[0] - want) < 1e-5


def test_gradients_equal_differences():
    net, rng = tiny()
    codes, labels = rng.integers(0, pii.PAD, (7, 4)), rng.integers(0, 5, (7, 4))
    codes[5:, 1], labels[5:, 1] = pii.PAD, 0
    grad = net.loss(codes, labels)[1]
    for name in net.NAMES:
        w = getattr(net, name)
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if name == "chars":
                at = (at[0], int(codes[rng.integers(0, 5), 0]), at[2])
            old, side = w[at], []
            for step in (2e-3, -2e-3):
                w[at] = old + step
                side.append(net.loss(codes, labels)[0])
            w[at] = old
            assert abs((side[0] - side[1]) / 4e-3 - grad[name][at]) < 1e-3


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return pii.train(docs.where("doc_id % 2 = 0"))


@pytest.fixture(scope="module")
def held(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1 and length(text) < 20000").orderBy("doc_id").limit(3000).collect()]


def test_held_out_accuracy(net, held):
    """The network alone finds the patterns' spans, and forms that the patterns don't know; clean texts stay clean."""
    base = [pii.base_spans(t) for t in held]
    found = {k: pii.joined(s) for k, s in pii.window_spans(net, held).items()}
    hit = sum(any(label - 1 == kind and x < b and a < y for _, label, x, y in found.get(k, [])) for k, spans in enumerate(base) for a, kind, b in spans)
    assert hit > 0.85 * sum(map(len, base)) > 50
    rng, forms, got = np.random.default_rng(3), 0, 0
    for t, spans in zip(held, base):
        for a, kind, b in spans[:1]:
            form = pii.other_form(kind + 1, t[a:b], rng)
            new = pii.all_spans(net, [t[:a] + form + t[b:]])[0]
            forms += 1
            got += any(s < a + len(form) and a < e and q == kind for s, q, e, _ in new)
    assert got > 0.7 * forms
    added = [(t[a:b]) for t, spans in zip(held, pii.all_spans(net, held)) for a, _, b, is_base in spans if not is_base]
    assert len(added) <= 0.002 * len(held)


def test_windows_are_reconciled(net):
    filler = "the inin of thatre an ster thing on "
    mail = "theran.43(at)mail4.example.com"
    for lead in range(180, 270, 9):
        text = (filler * 40)[:lead] + " " + mail + " " + filler * 12
        got = [(text[a:b]) for a, k, b, _ in pii.all_spans(net, [text])[0]]
        assert got == [mail], lead
    assert pii.joined([(5.0, 1, 200, 256, False, True), (4.0, 1, 208, 300, True, False)]) == [(5.0, 1, 200, 300)]
    spans = [(2.0, 1, 0, 5), (3.0, 2, 4, 9), (2.0, 1, 9, 12), (0.5, 3, 9, 10)]
    assert pii.reconciled(spans) == [(3.0, 2, 4, 9), (2.0, 1, 9, 12)]


def test_query_keeps_base_spans(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_pii"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain(rows[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        written = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",")) | ({""} if not written else set())


def test_nulls_long_texts_repeats_and_clashing_columns(spark, net):
    long_text = "word " * 60000 + "a.b@c.de"
    rows = [(k, t, "clash", 1) for k, t in enumerate([None, "", " ", long_text, *CASES])] + [(None, "a@b.cd", "x", 2)] * 2
    d = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, base int")
    for use in (net, None):
        got = pii.personal_data(d, use).collect()
        assert len(got) == len(rows)
        for r in got:
            text = "a@b.cd" if r.id is None else rows[r.id][1] or ""
            assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.base] == plain(text)
            assert use is not None or all(s.base for s in r.spans)
    assert pii.pii_digests(d.limit(0)).collect() == []
    assert {r.spans for r in pii.pii_digests(d.where("doc_id < 3")).collect()} == {""}
