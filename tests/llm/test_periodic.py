"""Periodic runs: the catchers against brute force, online and at once; the whole query against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from nluscore.llm import periodic
from nluscore.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words, least=2):
    """(period, start, end) of all runs, by comparing every word with the word p later."""
    n, out = len(words), {}
    for p in range(1, n // least + 1):
        a = 0
        while a < n - p:
            b = a
            while b < n - p and words[b] == words[b + p]:
                b += 1
            if b + p - a >= least * p and (a, b + p) not in out:
                out[a, b + p] = p
            a = max(b, a) + 1
    return {(p, a, b) for (a, b), p in out.items()}


@pytest.mark.parametrize("seed", range(30))
def test_catchers_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 1 + seed % 4, 5 + 5 * seed)
    for _ in range(seed % 3):
        a, p = rng.integers(0, len(words)), rng.integers(1, 9)
        words[a:a + 6 * p] = words[a + np.arange(len(words[a:a + 6 * p])) % p]
    want = brute(words.tolist())
    assert {tuple(x) for x in periodic.runs_of(words, len(words) // 2).tolist()} == want
    for step in (1, 2, 7):  # portions of any size report the same
        c = periodic.Catchers(len(words) // 2)
        for k in range(0, len(words), step):
            c.append(words[k:k + step])
            if seed < 10:
                assert {tuple(x) for x in c.squares().tolist()} == {x for x in brute(words[:k + step].tolist())}
        assert {tuple(x) for x in c.squares().tolist()} == want


def test_words_without_squares_and_names_that_collide(monkeypatch):
    thue = [bin(k).count("1") % 2 for k in range(600)]  # no stretch of exponent above 2
    assert not [x for x in periodic.runs_of(np.array(thue), 300).tolist() if x[2] - x[1] > 2 * x[0]]
    monkeypatch.setattr(periodic, "mixed", lambda x: x % np.uint64(3))
    with pytest.raises(RuntimeError):
        periodic.runs_of(np.arange(50), 25)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = sorted((a, b - a, p) for p, a, b in brute(w, 4) if b - a >= 6)
    drop = {i for a, m, p in runs for i in range(a + p, a + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
            hashlib.sha256("".join(f"{a},{m},{p}\n" for a, m, p in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.where("length(text) < 9000")
    want = sorted((expected(r.doc_id, r.text) for r in short.collect()), key=str)
    keep = {r[0] for r in want}
    assert [r for r in rows(QUERIES["op11_periodic_runs"](spark, SF)) if r[0] in keep] == want


def test_nulls_long_texts_ties_and_clashing_columns(spark):
    texts = [None, "", " \t\n", "a", "a a a a a a", "a a a a a", "a b " * 5, "x  y\tx\ny x y x y z", "é ü é ü é ü é ü", "a a a a a a b c c c c c c",
             "p q r " * 3000 + "end", " ".join(map(str, range(4000))), "w " * 6 + "v w w w w w w", "\x00 \x00 \x00 \x00 \x00 \x00"]
    data = [(k if k != 9 else None, t, "clash", [1]) for k, t in enumerate(texts)] + [(4, texts[4], "clash", [2])] * 3
    d = spark.createDataFrame(data, "doc_id bigint, text string, runs string, collapsed array<int>")
    assert rows(periodic.run_digests(d)) == sorted((expected(k, t) for k, t, *_ in data), key=str)
    assert rows(periodic.run_digests(d.limit(0))) == []
    got = periodic.periodic_runs(d.where("doc_id = 6")).first()
    assert got.runs == [(0, 10, 2)] and got.collapsed == "a b"
    with pytest.raises(ValueError):
        periodic.periodic_runs(d, least_exponent=1)
