"""run() of the pipeline against a brute-force version of every stage, on all small documents and odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from nluscore.llm import common, mixing
from nluscore.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    bits = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((bits >> np.uint64(b) & np.uint64(1)).sum()) > len(bits))


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.orderBy(F.length("text").desc()).first().text
    odd = [None, "", " 12 !\n", long, long.replace(" ", "  "), long + " one", long.upper()]
    extra = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(odd)], "doc_id bigint, text string")
    docs.unionByName(extra, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    kept, stored = {}, common.stored

    def keeping(df, name):
        out = stored(df, name)
        if name.startswith("pipeline-"):
            kept[name.removeprefix("pipeline-")] = out
        return out

    monkeypatch.setattr(common, "stored", keeping)
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert list(kept) == [name for name, _ in corpus_pipeline.STAGES]
    assert all(kept[name].columns == docs.columns for name in list(kept)[:-1])
    ids = {name: sorted(r.doc_id for r in kept[name].select("doc_id").collect()) for name in kept}

    want = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect() if any(map(str.isalpha, r.text or ""))}
    assert ids["language_id"] == sorted(want)
    best = {}
    for k, t in want.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(t), k))
    want = {k: want[k] for _, k in best.values()}
    assert ids["exact_dedup"] == sorted(want)

    names = sorted(want)
    prints = np.array([fingerprint(want[k]) for k in names], np.uint64)
    low = np.arange(len(names))
    linked = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    while True:
        new = np.array([low[row].min() for row in linked])
        if (new == low).all():
            break
        low = new
    want = {names[k]: want[names[k]] for k in sorted(set(low.tolist()))}
    assert ids["simhash_dedup"] == sorted(want)

    taken = {r.doc_id: r.taken for r in mixing.mixed_counts(kept["simhash_dedup"]).collect()}
    mixed, words = kept["mixing"].select("doc_id", "text").collect(), Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
        assert not Counter(r.text.split()) - Counter(want[r.doc_id].split())
    assert dict(words) == {k: n for k, n in taken.items() if n}

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = []
    for r in mixed:
        at = tok.encode(r.text, add_special_tokens=False).ids
        rows.append((r.doc_id, len(at), sha(np.array(at, "<u4").tobytes()), sha(tok.decode(at, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, result)) == sorted(rows)


def test_dedup_stages_keep_one_row_of_a_group(spark):
    one, two, three = ("".join(f"{w}{k} " for k in range(40)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, one, "a"), (1, one, "a"), (1, one, "b"), (1, two, "a"), (2, two, "a"), (2, " " + two, "a"), (3, one, "a"),
            (None, three, "a"), (None, three, "a"), (None, one, "a"), (None, two, "a"), (None, "", "a"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    exact = corpus_pipeline.exact_stage(spark, docs, SF)
    assert exact.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in exact.fillna("").collect()) == Counter([(1, one), (2, " " + two), (None, three), (None, "")])
    near = corpus_pipeline.near_stage(spark, docs, SF)
    assert near.columns == docs.columns
    assert Counter((r.doc_id, (r.text or "").strip()) for r in near.collect()) == Counter(
        [(1, one.strip()), (1, two.strip()), (None, three.strip()), (None, "")])


def test_stages_with_clashing_columns_and_empty_tables(spark):
    text = "".join(f"word{k} of text " for k in range(30))
    names = ["lang_pred", "score", "spans", "__id", "__key", "key", "row", "id", "digest"]
    rows = [(k, text + "x" * (k % 3), "en", "a", len(text), *[f"{n}{k}" for n in names], {"m": k}) for k in (1, 2, 3, 3)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                              + ", ".join(f"{n} string" for n in names) + ", map map<string,int>")
    for table in (d, d.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = common.stored(stage(spark, table, SF), "stage")
            assert table.columns == d.columns
            for r in table.collect():
                assert all(r[n] == f"{n}{r.doc_id}" for n in names) and r["map"] == {"m": r.doc_id}
        out = corpus_pipeline.bpe_stage(spark, table, SF)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == table.count()
