"""Rules of single operators by hand: text columns, templates, splits, label re-mapping, several outputs, metric names, strict chunks."""

import math
import os

import pytest
from pyspark.sql import functions as F

from nluscore.functions import text as TX
from nluscore.operators import choice as CH
from nluscore.operators import classify as C
from nluscore.operators import labels as L
from nluscore.operators import registry as G
from nluscore.operators import retrieval as R
from nluscore.operators import schema as S
from nluscore.operators import seq as Q
from nluscore.operators import tokens as T
from nluscore.operators.prefix import dense_rank_global
from nluscore.sources import sinks as K


def test_text_columns_of_tasks_and_tables(spark):
    assert TX.text_columns(["question", "sentence", "label"], "qnli") == ("question", "sentence")
    assert TX.text_columns(["sentence", "label", "idx"], "sst2") == ("sentence",)
    assert TX.text_columns(["x", "sentence2", "sentence1", "label"]) == ("sentence1", "sentence2")
    assert TX.text_columns(["label", "body", "title", "more"]) == ("body", "title")
    assert TX.text_columns(["a", "b", "label"], "unknown", chosen=["b"]) == ("b",)
    with pytest.raises(ValueError):
        TX.text_columns(["a", "label"], "mnli")
    df = spark.createDataFrame([("p", "h", 1)], "premise string, hypothesis string, label int")
    assert tuple(TX.text_pair(df, "mnli").select("text_a", "text_b").first()) == ("p", "h")
    assert tuple(TX.text_pair(df.drop("hypothesis")).select("text_a", "text_b").first()) == ("p", None)


def test_choice_templates_and_regrouping(spark):
    df = spark.createDataFrame([(1, "ctx", "why?", "x", "y"), (2, "c2", "q2", "z", "w")], "id int, context string, question string, e0 string, e1 string")
    both = {(r["id"], r["choice"]): (r["first_text"], r["second_text"]) for r in CH.explode_choice_pairs(df, "id", ["e0", "e1"]).collect()}
    assert both[1, 0] == ("ctx", "why? x") and both[2, 1] == ("c2", "q2 w")
    first = {(r["id"], r["choice"]): (r["first_text"], r["second_text"]) for r in CH.explode_choice_pairs(df, "id", ["e0", "e1"], question_in_first=True).collect()}
    assert first[1, 1] == ("ctx why?", "y")
    own = CH.explode_choice_pairs(df, "id", ["e0"], second="{ending}!").first()
    assert own["second_text"] in ("x!", "z!")
    scores = spark.createDataFrame([(1, 1, 0.2), (1, 0, 0.9), (2, 0, 0.1), (2, 1, 0.1)], "id int, choice int, score double")
    assert {r["id"]: r["scores"] for r in CH.regroup_choices(scores, "id").collect()} == {1: [0.9, 0.2], 2: [0.1, 0.1]}


def test_split_pair(spark):
    df = spark.createDataFrame([("validation_matched", 1), ("validation_mismatched", 2), ("test", 3)], "split string, x int")
    assert {k: [r["x"] for r in v.collect()] for k, v in S.split_pair(df, "validation").items()} == {"matched": [1], "mismatched": [2]}
    assert list(S.split_pair(df, "test")) == ["test"] and S.split_pair(df, "train") == {}


def test_label_sets_are_re_mapped_or_kept(spark):
    data = spark.createDataFrame([("entailment", 0), ("neutral", 1)], "label string, label_id long")
    model = spark.createDataFrame([("NEUTRAL", 0), ("ENTAILMENT", 1)], "label string, label_id long")
    got, same = L.settle_vocab(data, model)
    assert same and {r["label"]: r["label_id"] for r in got.collect()} == {"entailment": 1, "neutral": 0}
    for other in (model.limit(1), model.union(spark.createDataFrame([("x", 2)], "label string, label_id long"))):
        got, same = L.settle_vocab(data, other)
        assert not same and {r["label"]: r["label_id"] for r in got.collect()} == {"entailment": 0, "neutral": 1}
    u = L.label_union([data.select("label"), model.select(F.lower("label").alias("label"))], "label")
    assert sorted(r["label"] for r in u.collect()) == ["entailment", "neutral"]


def test_errors_of_several_outputs(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 4.0], 1.0), ([2.0, 2.0], [2.0, 2.0], 3.0)], "p array<double>, g array<double>, w double")
    assert C.mse(df, "p", "g").first()["mse"] == pytest.approx((0.5 + 8) / 2)
    assert C.mse(df, "p", "g", squared=False).first()["rmse"] == pytest.approx((math.sqrt(0.5) + math.sqrt(8)) / 2)
    raw = {r["output"]: r["mse"] for r in C.mse(df, "p", "g", weight="w", multioutput="raw_values").collect()}
    assert raw == {0: pytest.approx(0.25), 1: pytest.approx(4.0)}
    both = C.regression_metrics(df, "p", "g", weight="w").first()
    assert both["rmse"] == pytest.approx((math.sqrt(0.5) + math.sqrt(8)) / 2) and both["rmse_weighted"] == pytest.approx((0.5 + 2) / 2)


def test_f1_of_keys_with_two_and_more_classes(spark):
    rows = [("two", 1, 1), ("two", 0, 1), ("two", 0, 0), ("three", 1, 1), ("three", 2, 0), ("three", 0, 0), (None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, y int, p int")
    got = {r["k"]: r["value"] for r in G.problem_metrics(df, "single_label_classification", "p", "y", by="k", name="f1").collect()}
    assert got["two"] == pytest.approx(2 / 3, abs=1e-6) and got["three"] == pytest.approx((1 + 0 + 2 / 3) / 3, abs=1e-6) and got[None] == 1.0


def test_metric_names_of_reports(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "label int, pred int")
    assert {r["metric"] for r in G.report_names(G.glue_metrics(df, "cola")).collect()} == {"matthews_correlation"}
    assert C.matthews(df, "pred", "label").first()["mcc"] == pytest.approx(0.5)


def test_strict_chunks_of_lone_ends():
    assert Q.strict_chunks(["O", "E-A", "I-A", "E-A", "I-B"], "IOE1") == [("A", 2, 3), ("B", 4, 4)]
    assert Q.strict_chunks(["O", "E-A", "I-A", "E-A", "I-B"], "IOE2") == [("A", 1, 1), ("A", 2, 3)]


def test_relevance_ranks_offsets_and_tag_accuracy(spark):
    hits = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.8)], "qid long, docid long, score double")
    qrels = spark.createDataFrame([(1, 6, 1), (1, 6, 2), (2, 5, 1)], "qid long, docid long, rel int")
    assert sorted((r["docid"], r["rel"]) for r in R.attach_relevance(hits, qrels).collect()) == [(5, 0), (6, 2)]
    ranks = {r["x"]: r["dense_rank"] for r in dense_rank_global(spark.createDataFrame([(3,), (1,), (3,), (None,)], "x int"), "x").collect()}
    assert ranks == {1: 0, 3: 1}
    d = T.tokenize_offsets(spark.createDataFrame([("é ab\ncd",)], "text string"))
    assert d.select(T.tokens_from_offsets().alias("t")).first()["t"] == ["é", "ab", "cd"]
    tags = spark.createDataFrame([(["O", "B-X"], ["O", "O"]), (["O"], ["O"]), (None, ["O"])], "g array<string>, p array<string>")
    assert Q.tag_accuracy(tags, "g", "p").first()["accuracy"] == pytest.approx(2 / 3)


def test_tag_counts_equal_counts_of_extracted_entities(spark):
    import random

    rng = random.Random(3)
    tag = lambda: rng.choice(["O", "O", "B-X", "I-X", "B-Y", "I-Y", "E-X", "S-Y"])
    rows = [(k % 3, [tag() for _ in range(n)], [tag() for _ in range(n)]) for k, n in enumerate([0, 1, 5, 9, 30, 2, 7] * 4)]
    rows = [(k, g, [a if rng.random() < 0.7 else b for a, b in zip(g, p)]) for k, g, p in rows]
    df = spark.createDataFrame(rows, "k int, g array<string>, p array<string>")
    ents = Q.extract_entities(Q.extract_entities(df, "g", "ge"), "p", "pe")
    a = sorted(map(tuple, Q.entity_report(ents, "ge", "pe", by="k", gold_tags="g", pred_tags="p").collect()))
    assert a == sorted(map(tuple, Q.entity_report_from_tags(df, "g", "p", by="k").collect())) and a


def test_tag_lines_with_numbers(spark, tmp_dir):
    df = spark.createDataFrame([("en", 0, ["O", "B-X"]), ("en", 1, [])], "config string, n long, tags array<string>")
    path = os.path.join(tmp_dir, "tags")
    K.write_tags(df, path, index="n")
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["0\tO B-X", "1\t"]
