"""Vector search by block pairs, verified text identity, qrels and metrics on graded judgements, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nluscore.operators import evalset as E
from nluscore.operators import labels as L
from nluscore.operators import retrieval as R
from nluscore.operators import vectors as V


def brute_hits(q, d, k, tie):
    out = {}
    for qi, qv in q:
        scored = sorted(((round(float(np.dot(qv, dv)), 9), tie(di), di) for di, dv in d if di != qi), reverse=True)
        out[qi] = [(di, s) for s, _, di in scored[:k]]
    return out


@pytest.mark.parametrize("chunk_bytes", [64 << 20, 500, 64])
@pytest.mark.parametrize("kind,tie", [("string", "id"), ("bigint", "string"), ("bigint", "id")])
def test_search_of_any_id_type_and_tie_order(spark, chunk_bytes, kind, tie):
    rng = np.random.default_rng(3)
    vecs = rng.integers(-1, 2, (60, 4)).astype(float)
    name = (lambda k: f"E{k}") if kind == "string" else (lambda k: k)
    rows = [(name(k), v.tolist()) for k, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, f"id {kind}, v array<double>")
    got = V.top_k(df.filter(F.xxhash64("id") % 2 == 0), df, 6, "id", "id", "v", metric="dot", ignore_identical=True, chunk_bytes=chunk_bytes, tie=tie)
    assert dict(got.dtypes)["qid"] == dict(got.dtypes)["docid"] == kind
    want = brute_hits(rows, rows, 6, str if tie == "string" else (lambda x: x))
    by_q = {}
    for r in got.collect():
        by_q.setdefault(r["qid"], []).append((r["rank"], r["docid"], r["score"]))
    assert 0 < len(by_q) < 60
    for q, hits in by_q.items():
        assert [(d, s) for _, d, s in sorted(hits)] == want[q]


def test_search_of_empty_sides_nulls_and_wrong_arguments(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (3, None)], "id bigint, v array<double>")
    got = {(r["qid"], r["docid"]): r["score"] for r in V.top_k(df, df, 5, "id", "id", "v").collect()}
    assert set(got) == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} and got[1, 3] == got[3, 1] == -1.0 and got[1, 1] == 1.0
    assert V.top_k(df.limit(0), df, 5, "id", "id", "v").count() == V.top_k(df, df.limit(0), 5, "id", "id", "v").count() == 0
    with pytest.raises(ValueError):
        V.top_k(df, df, 5, "id", "id", "v", tie="length")


def trec(hits, qrels, ks):
    """Means over judged queries with hits as trec evaluations take them; MRR over all judged queries in the search's order."""
    sums, n = {}, 0
    for q, judged in qrels.items():
        found = hits.get(q)
        heap = sorted(found or [], key=lambda h: (-h[1], -h[0]))
        for k in ks:
            ranks = [i for i, (d, _) in enumerate(heap[:k]) if judged.get(d, 0) > 0]
            sums[f"mrr_at_{k}"] = sums.get(f"mrr_at_{k}", 0) + (1 / (ranks[0] + 1) if ranks else 0) / len(qrels)
        if not found:
            continue
        n += 1
        order = sorted(found, key=lambda h: (h[1], str(h[0])), reverse=True)
        rel = [judged.get(d, 0) for d, _ in order]
        ideal = sorted((g for g in judged.values() if g > 0), reverse=True)
        for k in ks:
            hit = [i for i, g in enumerate(rel[:k]) if g > 0]
            dcg = sum(g / math.log2(i + 2) for i, g in enumerate(rel[:k]))
            best = sum(g / math.log2(i + 2) for i, g in enumerate(ideal[:k]))
            for name, v in (("map", sum((j + 1) / (i + 1) for j, i in enumerate(hit)) / len(ideal) if ideal else 0), ("ndcg", dcg / best if best else 0),
                            ("recall", len(hit) / len(ideal) if ideal else 0), ("precision", len(hit) / k)):
                sums[f"{name}_at_{k}"] = sums.get(f"{name}_at_{k}", 0) + v
    return {m: v if m.startswith("mrr") else v / n for m, v in sums.items()}


@pytest.mark.parametrize("seed", range(3))
def test_qrels_metrics_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    hits = {q: [(d, float(rng.randrange(4))) for d in rng.sample(range(5, 130), 8)] for q in range(25) if q % 5}
    qrels = {q: {d: rng.randrange(4) for d in {*rng.sample(range(5, 130), 6), *(x for x, _ in hits.get(q, [])[:3])}} for q in range(22)}
    qrels[1] = {d: 0 for d in qrels[1]}  # judged, nothing relevant
    h = spark.createDataFrame([(q, d, s) for q, v in hits.items() for d, s in v], "qid long, docid long, score double")
    rows = [(q, d, g, f"s{q % 2}") for q, v in qrels.items() for d, g in v.items()]
    j = spark.createDataFrame(rows + rows[:9], "qid long, docid long, rel int, source string")  # some pairs twice
    ks = [1, 3, 8]
    got = {r["metric"]: r["value"] for r in R.qrels_metrics(h, j, ks).collect()}
    want = trec(hits, qrels, ks)
    assert set(got) == set(want) and all(abs(got[m] - want[m]) < 1e-6 for m in want)
    per = {(r["source"], r["metric"]): r["value"] for r in R.qrels_metrics(h, j, ks, by="source").collect()}
    for s in (0, 1):
        want = trec(hits, {q: v for q, v in qrels.items() if q % 2 == s}, ks)
        assert all(abs(per[f"s{s}", m] - want[m]) < 1e-6 for m in want)


@pytest.mark.parametrize("key", [L.text_key, lambda t: F.coalesce(F.length(t), F.lit(0)), lambda t: F.lit(1)])
def test_text_identity_survives_clashing_keys(spark, key):
    texts = ["b", "a", None, "", "b", None, "ab", "ba", "a", "é", "ab", "c"] + ["hot text"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["corpus_id"], r["is_first"]) for r in L.dedupe_corpus(df, key=key).collect()}
    seen = {}
    for k, t in enumerate(texts):
        new = t not in seen
        seen.setdefault(t, len(seen))
        assert got[k] == (seen[t], new)


def test_build_qrels_merges_configs(spark):
    rows = [("en", 2, "q0", "shared"), ("de", 1, "q1", "shared"), ("en", 1, "q2", "only en"), ("fr", 9, "q3", None), ("de", 2, "q4", "only de"), ("fr", 8, "q5", None)]
    df = spark.createDataFrame(rows, "config string, n int, question string, passage string")
    for key in (L.text_key, lambda t: F.lit(0)):
        s = E.build_qrels(df, "passage", "n", "config", ["question"], key=key)
        q = {r["qid"]: (r["source"], r["question"]) for r in s.queries.collect()}
        assert q == {0: ("de", "q1"), 1: ("de", "q4"), 2: ("en", "q2"), 3: ("en", "q0"), 4: ("fr", "q5"), 5: ("fr", "q3")}
        assert {r["docid"]: r["passage"] for r in s.corpus.collect()} == {0: "shared", 1: "only de", 2: "only en", 3: None}
        assert {(r["qid"], r["docid"], r["rel"], r["source"]) for r in s.qrels.collect()} == {
            (0, 0, 1, "de"), (1, 1, 1, "de"), (2, 2, 1, "en"), (3, 0, 1, "en"), (4, 3, 1, "fr"), (5, 3, 1, "fr")}


def test_external_ids_as_judgements(spark):
    mentions = spark.createDataFrame([("en", 1, [1.0, 0.0], "Q7"), ("de", 1, [0.0, 1.0], "Q10"), ("de", 2, [1.0, 1.0], None)],
                                     "config string, n int, v array<double>, entity_id string")
    entities = spark.createDataFrame([("Q7", [1.0, 0.1]), ("Q10", [1.0, 0.2]), ("Q9", [0.1, 1.0])], "docid string, v array<double>")
    queries, qrels = E.external_qrels(mentions, "entity_id", "n", "config", ["v"])
    assert dict(qrels.dtypes)["docid"] == "string" and qrels.count() == 2 and queries.count() == 3
    got = {(r["source"], r["metric"]): r["value"] for r in E.evaluate(queries, entities, qrels, [1, 3], vec="v").collect()}
    assert got["merged", "mrr_at_3"] == pytest.approx((1 + 0.5) / 2) and got["en", "map_at_1"] == 1.0 and got["de", "recall_at_1"] == 0.0
