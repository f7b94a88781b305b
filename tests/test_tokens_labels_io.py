"""Token windows, span labels, tag alignment, vocabularies and I/O round trips."""

import json
import os

import pytest
from pyspark.sql import functions as F

from nluscore.operators import labels as L
from nluscore.operators import tokens as T
from nluscore.operators.passages import find_passages
from nluscore.sources import readers as R
from nluscore.sources import sinks as K


def test_offsets_and_windows(spark):
    text = " ab  c dé\nf g h "
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t = T.tokenize_offsets(df).first()
    want = [(m.start(), m.end()) for m in __import__("re").finditer(r"\S+", text)]
    assert list(zip(t["starts"], t["ends"])) == want
    w = T.window_bounds(T.window_tokens(T.tokenize_offsets(df), "n_tokens", 3, 1)).orderBy("window_id").collect()
    # 6 tokens, size 3, step 2 → windows [0,3) [2,5) [4,6)
    assert [(r["tok_start"], r["tok_end"]) for r in w] == [(0, 3), (2, 5), (4, 6)]
    assert w[1]["char_start"] == want[2][0] and w[1]["char_end"] == want[4][1]


def test_span_labels_inside_and_outside(spark):
    df = spark.createDataFrame([(1, "aa bb cc dd ee", 3, 8)], "doc_id long, text string, sc int, ec int")
    w = T.window_tokens(T.tokenize_offsets(df), "n_tokens", 3, 1)
    got = {r["window_id"]: (r["start_position"], r["end_position"]) for r in T.span_labels(w, "sc", "ec").collect()}
    # tokens 0:aa 1:bb 2:cc 3:dd 4:ee; answer "bb cc" = tokens 1..2; window 0 = [0,3), window 1 = [2,5)
    assert got[0] == (2, 3) and got[1] == (0, 0)


def test_passages_first_occurrence(spark):
    docs = spark.createDataFrame([(1, "xx abc yy abc"), (2, "none"), (3, "ab")], "doc_id long, text string")
    ps = spark.createDataFrame([(7, "abc"), (8, "b"), (9, "")], "item_id long, text string")
    got = sorted(tuple(r) for r in find_passages(docs, ps).collect())
    assert got == [(1, 7, 3), (1, 8, 4), (3, 8, 1)]


def test_passages_of_any_length_equal_find(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é日") for _ in range(rng.randrange(0, 400))) for _ in range(60)] + [None, "", "ab" * 3000]
    parts = [t[a:a + n] for t in texts if t for a, n in [(rng.randrange(len(t)), rng.choice([1, 2, 3, 7, 15, 16, 17, 40, 200]))]]
    parts += ["", "ab" * 2990, "absent passage that no text holds", "absent passage that no text holds either", "ab" * 2990]
    docs = spark.createDataFrame([(f"d{k}", t, "clash") for k, t in enumerate(texts)], "doc_id string, text string, hash string")
    ps = spark.createDataFrame(list(enumerate(parts)), "item_id long, text string")
    want = sorted((f"d{k}", i, t.find(p)) for k, t in enumerate(texts) for i, p in enumerate(parts) if p and t and p in t)
    assert sorted(tuple(r) for r in find_passages(docs, ps).collect()) == want
    assert find_passages(docs, ps.limit(0)).count() == find_passages(docs.limit(0), ps).count() == 0


def test_windows_carry_their_own_slices(spark):
    df = spark.createDataFrame([(1, "w " * 5000), (2, ""), (3, None)], "doc_id long, text string")
    w = T.window_tokens(T.tokenize_offsets(df), "n_tokens", 128, 32)
    rows = w.collect()
    assert all(len(r["starts"] or []) == r["tok_end"] - r["tok_start"] for r in rows if r["doc_id"] < 3)
    assert [r["tok_start"] for r in rows if r["doc_id"] == 1] == list(range(0, 4897, 96))
    assert "starts" in w.columns and len([r for r in rows if r["doc_id"] == 2]) == 1


def test_span_search_equals_counting(spark):
    rows = [(a, v) for a in ([], [3], [1, 4, 4, 9], list(range(0, 256, 2))) for v in (-1, 0, 1, 3, 4, 5, 100, 300)]
    df = spark.createDataFrame(rows, "a array<int>, v int")
    got = df.select("a", "v", T.count_below(F.col("a"), F.col("v"), 128, True).alias("i"), T.count_below(F.col("a"), F.col("v"), 128, False).alias("e")).collect()
    assert all(r["i"] == sum(x <= r["v"] for x in r["a"]) and r["e"] == sum(x < r["v"] for x in r["a"]) for r in got)


@pytest.mark.parametrize("strategy", ["longest_first", "only_first", "only_second"])
def test_pair_truncation_equals_the_tokenizer_library(spark, strategy):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer(tokenizers.models.WordLevel({"w": 0, "[UNK]": 1}, unk_token="[UNK]"))
    tok.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    sizes = [(a, b, m) for a in range(0, 12) for b in range(0, 12) for m in (1, 4, 5, 9)]
    want = {}
    for a, b, m in sizes:
        tok.enable_truncation(m, strategy=strategy)
        try:
            e = tok.encode("w " * a, "w " * b)
            want[a, b, m] = (e.type_ids.count(0), e.type_ids.count(1), False)
        except Exception:  # too short to be cut
            want[a, b, m] = (a, b, True)
    for m in (1, 4, 5, 9):
        df = spark.createDataFrame([(a, b) for a, b, n in sizes if n == m], "a int, b int")
        for r in df.select("a", "b", T.pair_lengths(F.col("a"), F.col("b"), m, strategy).alias("n")).collect():
            assert tuple(r["n"]) == want[r["a"], r["b"], m], (r, m)
    df = spark.createDataFrame([(["a", "b", "c"], ["d", "e", "f"])], "x array<string>, y array<string>")
    r = T.truncate_pair(df, "x", "y", 6, "only_second", special=2).first()
    assert (r["x"], r["y"], r["truncation_error"]) == (["a", "b", "c"], ["d"], False)


def test_vocab_encode_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("-1",), ("b",)], "lab string")
    v = L.label_list(df, "lab")
    assert sorted((r["label"], r["label_id"]) for r in v.collect()) == [("a", 0), ("b", 1)]
    enc = L.encode_label(df, v, "lab").collect()
    assert sorted(r["label_id"] for r in enc) == [-1, 0, 1, 1]
    bad = spark.createDataFrame([("z",)], "lab string")
    with pytest.raises(Exception):
        L.encode_label(bad, v, "lab").collect()


def test_b_to_i_and_align(spark):
    v = spark.createDataFrame([("B-X", 0), ("I-X", 1), ("O", 2), ("B-Y", 3)], "label string, label_id long")
    b2i = {r["label"]: r["label_all_id"] for r in L.b_to_i(v).collect()}
    assert b2i == {"B-X": 1, "I-X": 1, "O": 2, "B-Y": 3}
    df = spark.createDataFrame([(1, ["abcdef", "g"], ["B-X", "O"])], "id int, w array<string>, t array<string>")
    rows = T.align_tags(df, "w", "t", 4, v, L.b_to_i(v)).orderBy("pos").collect()
    assert [(r["word_id"], r["label_id"], r["label_all_id"]) for r in rows] == [
        (None, -100, -100), (0, 0, 0), (0, -100, 1), (1, 2, 2), (None, -100, -100)]


def test_dedupe_corpus_first_seen(spark):
    df = spark.createDataFrame([(5, "x"), (2, "y"), (9, "x"), (3, "z")], "doc_id long, text string")
    got = {r["doc_id"]: r["corpus_id"] for r in L.dedupe_corpus(df).collect()}
    assert got == {2: 0, 3: 1, 5: 2, 9: 2}


def test_read_files_validate_and_roundtrip(spark, tmp_dir):
    with pytest.raises(ValueError):
        R.validate_sources({"train": "a.csv", "test": "b.json"})
    with pytest.raises(ValueError):
        R.validate_sources({"train": "a.txt"})
    p = os.path.join(tmp_dir, "train.csv")
    with open(p, "w") as f:
        f.write('sentence,label\n"a, b",1\n"c\nd",0\n')
    df = R.read_files(spark, {"train": p}, "sentence string, label int", multiline=True)
    assert sorted((r["sentence"], r["label"], r["split"]) for r in df.collect()) == [("a, b", 1, "train"), ("c\nd", 0, "train")]


def test_read_results_both_layouts(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "m1", "xnli"))
    with open(os.path.join(tmp_dir, "m1", "xnli", "all_results.json"), "w") as f:
        json.dump({"eval_accuracy": 0.5, "all_metrics": {"en": {"eval_accuracy": 0.7}}}, f)
    with open(os.path.join(tmp_dir, "m1", "xnli.json"), "w") as f:
        json.dump({"eval_accuracy": 0.1}, f)
    with open(os.path.join(tmp_dir, "m1", "cola.json"), "w") as f:
        json.dump({"eval_mcc": 0.3}, f)
    got = sorted(tuple(r) for r in R.read_results(spark, tmp_dir).collect())
    assert got == [("m1", "cola", "", "eval_mcc", 0.3), ("m1", "xnli", "", "eval_accuracy", 0.5),
                   ("m1", "xnli", "en", "eval_accuracy", 0.7)]


def test_write_predictions_and_metrics(spark, tmp_dir):
    df = spark.createDataFrame([("en", 0, 1.23456), ("fr", 1, 2.0)], "config string, index long, prediction double")
    out = os.path.join(tmp_dir, "pred")
    K.write_predictions(df, out, kind="regression")
    back = spark.read.option("sep", "\t").option("header", True).csv(out)
    assert sorted((r["config"], r["prediction"]) for r in back.collect()) == [("en", "1.235"), ("fr", "2.000")]
    m = spark.createDataFrame([("accuracy", 0.5), ("eval_f1", 0.25)], "metric string, value double")
    K.write_metrics(m, os.path.join(tmp_dir, "metrics"), prefix="eval", stamp={"config": "en"})
    got = sorted(r["metric"] for r in spark.read.json(os.path.join(tmp_dir, "metrics")).collect())
    assert got == ["eval_accuracy", "eval_f1"]


def test_compact_results(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "in", "m1"))
    with open(os.path.join(tmp_dir, "in", "m1", "cola.json"), "w") as f:
        json.dump({"eval_mcc": 0.3, "all_metrics": {"en": {"eval_mcc": 0.4}}}, f)
    out = os.path.join(tmp_dir, "compact")
    R.compact_results(spark, os.path.join(tmp_dir, "in"), out)
    got = sorted((r["model"], r["task"], r["config"], r["metric"], r["value"]) for r in spark.read.parquet(out).collect())
    assert got == [("m1", "cola", "", "eval_mcc", 0.3), ("m1", "cola", "en", "eval_mcc", 0.4)]
