"""Steps whose memory, shuffles or largest task must not grow faster than the input."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nluscore.operators import labels as L
from nluscore.operators import seq as S
from nluscore.operators import tokens as T
from nluscore.operators import vectors as V
from nluscore.plans import qa as QP
from nluscore.plans import tokens as TP


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_entity_counts_by_hand(spark):
    """Null lists, null entities and fields, repeats; a type named like the total."""
    e = "array<struct<type:string,start:int,end:int>>"
    rows = [("a", [("X", 0, 1), ("X", 0, 1), ("Y", 3, 3)], [("X", 0, 1), ("Y", 3, 4)], 2.0),
            ("a", [], [("X", 5, 6)], 1.0), ("a", None, [("X", 0, 0)], 1.0), ("b", [("X", 0, 0)], None, 1.0),
            ("b", [(None, 1, 2), ("overall", 4, None), None], [(None, 1, 2), ("overall", 4, None), None], 1.0)]
    df = spark.createDataFrame(rows, f"k string, g {e}, p {e}, w double")
    got = {(r["k"], r["type"]): (r["n_gold"], r["n_pred"], r["n_tp"]) for r in S.entity_counts(df, "g", "p", "k", "w").collect()}
    assert got == {("a", "X"): (4, 3, 2), ("a", "Y"): (2, 2, 0), ("a", "overall"): (6, 5, 2),
                   ("b", None): (2, 2, 2), ("b", "overall"): (4, 4, 4)}


def test_entity_counts_leave_no_row_per_entity(spark):
    df = spark.createDataFrame([(["B-x"] * 40, ["B-x"] * 40)], "g array<string>, p array<string>")
    df = S.extract_entities(S.extract_entities(df, "g", "ge"), "p", "pe")
    assert "array_intersect" not in plan(S.entity_counts(df, "ge", "pe", gold_tags="g", pred_tags="p"))


@pytest.mark.parametrize("step", ["tags", "pieces", "offsets", "counts"])
def test_kernels_need_little_beside_their_batch(step):
    texts = pa.array(["Some words of Text and more" * 3] * 60_000)
    words = pa.array([["Some", "words", "of", "Text"] * 4] * 60_000)
    tags = pa.array([["B-en", "O", "O", "I-en"] * 4] * 60_000)
    run = {"tags": lambda: TP._word_tags_udf({"gold": 0, "pred": 3}).func(texts, pa.array(["en"] * len(texts))),
           "pieces": lambda: T._pieces_udf(4).func(words, tags), "offsets": lambda: T.token_offsets.func(texts),
           "counts": lambda: S._tag_counts_udf(False).func(tags, tags)}[step]
    assert peak_mb(run) < 20


@pytest.mark.parametrize("most", [0, 100])
def test_tags_meet_their_ids_without_a_partition_per_tag(spark, most):
    df = spark.createDataFrame([(i, ["ab", "cdefg", "h"], ["O", "B-x", None]) for i in range(30)], "id int, w array<string>, t array<string>")
    vocab = L.label_list(spark.createDataFrame([(["O", "B-x", "I-x"],)], "t array<string>"), "t", multi=True)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = T.align_tags(df, "w", "t", 4, vocab, L.b_to_i(vocab), broadcast_labels=most)
        assert ("BroadcastHashJoin [_tag#" in plan(out)) == (most > 0)
        assert ("_way" in plan(out)) == (most == 0)
        got = sorted((r["pos"], r["label_id"], r["label_all_id"]) for r in out.filter("id = 7").collect() if r["pos"] < 4)
        assert out.count() == 30 * 6 and "_way" not in out.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == [(0, -100, -100), (1, 2, 2), (2, 0, 0), (3, -100, 1)]


def test_pairs_meet_once_for_all_strategies(spark, tmp_dir):
    rows = [(1, 0, "user", "a " * 30), (1, 1, "assistant", "b " * 9), (2, 0, "user", "x"), (2, 1, "assistant", None), (None, 0, "user", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_dir}/conversations.parquet")
    out = TP.pair_truncation(spark, tmp_dir)
    assert plan(out).split("== Initial Plan ==")[-1].count("Join ") == 1
    got = {(r["conv_id"], r["strategy"]): (r["first"], r["second"], r["truncation_error"]) for r in out.collect()}
    assert len(got) == 6
    assert got[1, "longest_first"] == (" ".join("a" * 12), " ".join("b" * 9), False)
    assert got[1, "only_second"] == (" ".join("a" * 30), " ".join("b" * 9), True)
    assert got[1, "only_first"] == (" ".join("a" * 12), " ".join("b" * 9), False)
    assert got[2, "only_first"][1] is None


def test_search_cells_stay_small_and_both_sides_are_cut(spark):
    df = spark.range(40_000).select(F.array_repeat(F.lit(0.5), 64).alias("v"))
    assert V.vector_blocks(df, "v") == 3
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert V.vector_blocks(df, "v", across=1) == min(parts, 10)
    assert V.vector_blocks(df, "v", across=3) == 3


def test_windows_of_known_numbers(spark):
    """Entries name windows of a text: repeats give rows, numbers beyond the text none; slices are those of all windows."""
    df = spark.createDataFrame([(1, "a b c d e f g", [(0, "x"), (2, "y"), (2, "z"), (9, "w")]), (2, None, [(0, "n"), (1, "m")]), (3, "a", None)],
                               "id int, text string, known array<struct<window_id:int,v:string>>")
    tok = T.tokenize_offsets(df).drop("text")
    every = {(r["id"], r["window_id"]): r for r in T.window_tokens(tok.drop("known"), "n_tokens", 3, 1).collect()}
    got = T.window_tokens(tok, "n_tokens", 3, 1, given="known").collect()
    assert sorted((r["id"], r["window_id"], r["v"]) for r in got) == [(1, 0, "x"), (1, 2, "y"), (1, 2, "z"), (2, 0, "n")]
    for r in got:
        assert all(r[c] == every[r["id"], r["window_id"]][c] for c in ("tok_start", "tok_end", "starts", "ends"))


def test_offsets_stay_with_their_text(spark, tmp_dir):
    """Window numbers alone are dealt by vector: no exchange of the features carries offsets."""
    words = " ".join(f"w{i}" for i in range(150))
    spark.createDataFrame([(7, words), (7, "one two"), (8, None), (None, "x")], "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(i, [float(i)] * 64) for i in range(5)] + [(0, [9.0] * 64)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_dir}/embeddings.parquet")
    feats, _ = QP._features(spark, tmp_dir)
    for line in feats._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert "Join" not in line or "vec_id" not in line or "offsets" not in line
    below = feats._jdf.queryExecution().optimizedPlan().toString().split("vec_id#")
    assert "offsets#" not in below[-1] and "feature" not in below[-1]
    got = sorted((r["example_id"], r["feature"], r["start_logits"][0], len(r["offsets"] or [])) for r in feats.collect())
    # six vectors are counted: window w of document d has vector (d + 7 w) mod 6, and vector 0 is there twice
    assert got == [(7, 0, 1.0, 4), (7, 0, 1.0, 64), (7, 1, 2.0, 64), (7, 2, 3.0, 60), (8, 0, 2.0, 0)]
