"""Registry, schema ops, remaining column functions, sinks and readers."""

import json
import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from nluscore.functions import text as TX
from nluscore.operators import labels as L
from nluscore.operators import registry as RG
from nluscore.operators import schema as SC
from nluscore.operators import tuples as X
from nluscore.sources import readers as R
from nluscore.sources import sinks as K


def test_glue_bundles(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0), (1, 1)], "pred int, label int")
    mrpc = {r["metric"]: r["value"] for r in RG.glue_metrics(df, "mrpc").collect()}
    assert set(mrpc) == {"accuracy", "f1", "combined_score"}
    assert math.isclose(mrpc["combined_score"], round((mrpc["accuracy"] + mrpc["f1"]) / 2, 6), abs_tol=1e-6)
    assert {r["metric"] for r in RG.glue_metrics(df, "cola").collect()} == {"mcc"}
    reg = spark.createDataFrame([(1.0, 1.5), (2.0, 2.5), (3.0, 2.0)], "pred double, label double")
    assert {r["metric"] for r in RG.glue_metrics(reg, "stsb").collect()} == {"pearson", "spearman", "combined_score"}
    with pytest.raises(KeyError):
        RG.glue_metrics(df, "nope")


def test_problem_metrics_defaults(spark):
    assert RG.pick_metric("regression") == "mse" and RG.pick_metric("multi_label_classification") == "f1"
    assert RG.pick_metric("single_label_classification") == "accuracy"
    logits = spark.createDataFrame([([0.1, 0.9], 1), ([0.8, 0.2], 1)], "p array<double>, y int")
    assert RG.problem_metrics(logits, "single_label_classification", "p", "y").first()["value"] == 0.5
    ml = spark.createDataFrame([([1.0, -1.0], [1, 0]), ([1.0, 1.0], [1, 0])], "p array<double>, y array<int>")
    assert math.isclose(RG.problem_metrics(ml, "multi_label_classification", "p", "y").first()["value"], 0.8)
    rg = spark.createDataFrame([([1.0], 2.0), ([3.0], 3.0)], "p array<double>, y double")
    assert RG.problem_metrics(rg, "regression", "p", "y").first()["value"] == 0.5


def test_merge_matched_and_counts(spark):
    m = spark.createDataFrame([("accuracy", 0.5)], "metric string, value double")
    got = sorted(r["metric"] for r in RG.merge_matched(m, m).collect())
    assert got == ["accuracy", "accuracy_mm"]
    df = spark.range(7)
    assert RG.sample_counts(df, "eval", limit=5).first()["value"] == 5.0


def test_hooks(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0)], "k int, v double")
    out = RG.map_batches(df, lambda p: p.assign(v=p.v * 2), "k int, v double")
    assert sorted(r["v"] for r in out.collect()) == [4.0, 6.0, 8.0]
    med = RG.custom_metric(df, lambda p: pd.DataFrame({"k": [p.k.iloc[0]], "med": [p.v.median()]}), "k int, med double", by="k")
    assert sorted(tuple(r) for r in med.collect()) == [(1, 3.0), (2, 3.0)]
    assert RG.post_process(df, lambda d: d.filter("k = 2")).count() == 1


def test_schema_ops(spark, tmp_dir):
    df = spark.createDataFrame([("a", "b", "1", "train"), ("c", "d", "x", "validation")], "q string, c string, lab string, split string")
    roles = SC.resolve_columns(df, ["question", "context"], explicit={"context": "c"}, known={"question": ["question", "q"]})
    assert roles == {"question": "q", "context": "c"}
    assert SC.resolve_columns(df, ["first"]) == {"first": "q"}
    with pytest.raises(Exception):
        SC.cast_label(df, "lab", "int").collect()
    assert SC.cast_label(df.filter("lab = '1'"), "lab", "int").first()["lab"] == 1
    test = SC.select_split(df, "test", fallback={"test": "validation"})
    assert [r["q"] for r in test.collect()] == ["c"]
    ren = SC.select_split(df, "dev", rename={"validation": "dev"})
    assert ren.count() == 1
    big = spark.range(100).withColumnRenamed("id", "k")
    assert [r["k"] for r in SC.head_rows(big, 3, ["k"]).collect()] == [0, 1, 2]
    a = [r["k"] for r in SC.shuffle_rows(big, 7, ["k"]).collect()]
    b = [r["k"] for r in SC.shuffle_rows(big.repartition(5), 7, ["k"]).collect()]
    assert a == b and sorted(a) == list(range(100)) and a != list(range(100))
    assert SC.sample_rows(big, 5, 7, ["k"]).count() == 5
    assert SC.drop_columns(df, ["c", "zzz"]).columns == ["q", "lab", "split"]


def test_text_functions(spark):
    df = spark.createDataFrame([("  hi there", "x", [0.5, -1.0], [3.0])], "s string, t string, a array<double>, one array<double>")
    r = df.select(TX.lstrip("s").alias("l"), TX.slice_text(F.col("s"), F.lit(2), F.lit(4)).alias("sl"),
                  TX.threshold_multihot("a").alias("m"), TX.squeeze("one").alias("q"),
                  TX.fill_template("{context} | {t}!", {"context": "s"}).alias("f")).first()
    assert r["l"] == "hi there" and r["sl"] == "hi" and r["m"] == [1, 0] and r["q"] == 3.0
    assert r["f"] == "  hi there | x!"
    nul = spark.createDataFrame([("a", None)], "a string, b string")
    with pytest.raises(Exception):
        nul.select(TX.concat_text(["a", "b"])).collect()
    assert nul.select(TX.as_array("a", "string").alias("x")).first()["x"] == ["a"]


def test_vocab_alignment_and_decode(spark):
    data = spark.createDataFrame([("Entailment", 0), ("neutral", 1)], "label string, label_id long")
    model = spark.createDataFrame([("neutral", 0), ("entailment", 1), ("contradiction", 2)], "label string, label_id long")
    al = {(r["data_label"], r["model_id"]): r["matched"] for r in L.align_vocab(data, model).collect()}
    assert al[("Entailment", 1)] and al[("neutral", 0)] and al[(None, 2)] is False
    ids = spark.createDataFrame([(1,), (0,)], "label_id long")
    assert sorted(r["label"] for r in L.decode_label(ids, data, "label_id").collect()) == ["Entailment", "neutral"]
    hot = spark.createDataFrame([([1.0, 0.0, 1.0],)], "h array<double>")
    assert hot.select(L.decode_multihot(F.col("h"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("x")).first()["x"] == ["a", "c"]
    assert L.infer_problem(spark.createDataFrame([(1.5,)], "y double"), "y") == "regression"
    assert L.infer_problem(spark.createDataFrame([([1, 2],)], "y array<int>"), "y") == "multi_label_classification"
    with pytest.raises(ValueError):
        L.infer_problem(spark.createDataFrame([(1,), (1,)], "y int"), "y")


def test_negative_draws(spark):
    rows = [(i, i % 2) for i in range(20)]
    e = spark.createDataFrame(rows, "vec_id long, label int")
    members = X.index_members(e, "label", "vec_id", "vec_id")
    inst = members.select(F.col("_item").alias("q"), F.pmod(F.col("label") + 1, F.lit(2)).alias("ng"))
    shuf = X.pick_negatives(inst, members, "q", "ng", 4, 3, 42, shuffle=True).collect()
    per = {}
    for r in shuf:
        per.setdefault(r["q"], []).append(r["negative"])
    assert all(len(v) == 4 and len(set(v)) == 4 for v in per.values())      # X5: a permutation slice
    assert all((n % 2) != (q % 2) for q, v in per.items() for n in v)
    draws = X.pick_negatives(inst, members, "q", "ng", 15, 0, 42).collect()  # m = 10 < 15: X3 draws
    assert all(r["negative"] % 2 != r["q"] % 2 for r in draws) and len(draws) == 20 * 15


def test_task_store_pruning_and_configs(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src.json")
    with open(src, "w") as f:
        f.write('{"premise": "p", "hypothesis": "h", "label": 1}\n')
    root = os.path.join(tmp_dir, "store")
    R.ingest([{"dataset": "xnli", "config": c, "split": "test", "path": src} for c in ("en", "fr")], spark, root)
    df = R.read_task(spark, root, "xnli", "fr", "test")
    assert df.count() == 1
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    part = [ln for ln in plan.splitlines() if "PartitionFilters" in ln]
    assert part and "fr" in part[0] and "xnli" in part[0]
    assert R.list_configs(R.read_task(spark, root), "all_config") == ["en", "fr"]
    assert R.list_configs(None, "en,fr,en") == ["en", "fr"]
    nested = os.path.join(tmp_dir, "nested.json")
    with open(nested, "w") as f:
        json.dump({"version": 1, "data": [{"id": "a", "x": 1}, {"id": "b", "x": 2}]}, f)
    assert sorted(r["id"] for r in R.read_nested(spark, nested).collect()) == ["a", "b"]
    assert R.read_corpus(spark.createDataFrame([(1, "t")], "id long, text string")).columns == ["docid", "text"]


def test_sinks(spark, tmp_dir):
    tags = spark.createDataFrame([("en", ["B-X", "O"])], "config string, tags array<string>")
    K.write_tags(tags, os.path.join(tmp_dir, "tags"))
    assert spark.read.text(os.path.join(tmp_dir, "tags")).first()["value"] == "B-X O"
    ans = spark.createDataFrame([("en", 1, "x")], "config string, example_id long, prediction_text string")
    nb = spark.createDataFrame([("en", 1, 0, "x", 0.9, 1.0, 2.0)],
                               "config string, example_id long, rank int, text string, probability double, start_logit float, end_logit float")
    K.write_qa_outputs(ans, nb, os.path.join(tmp_dir, "qa"), null_odds=ans.select("config", "example_id"))
    back = spark.read.json(os.path.join(tmp_dir, "qa", "eval_nbest_predictions")).first()
    assert back["nbest"][0]["text"] == "x"
    rep = spark.createDataFrame([("m", 1.0)], "model string, avg double")
    K.write_report(rep, os.path.join(tmp_dir, "rep"))
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "rep")).first()["model"] == "m"


def test_list_instances_and_format(spark):
    from nluscore.operators import qa as Q
    from nluscore.operators import seq as S
    from nluscore.operators import tokens as T
    df = spark.createDataFrame([(3, "q", "p", ["n0", "n1", "n2", "n3", "n4"])], "id long, query string, pos string, neg array<string>")
    inst = X.build_instances(df, "query", "pos", "neg")
    r = inst.select(X.pick_positive_list(F.col("id"), F.col("positives"), 1).alias("p"),
                    X.pick_negatives_list(F.col("id"), F.col("negatives"), 3, 1).alias("rr"),
                    X.pick_negatives_list(F.col("id"), F.col("negatives"), 3, 1, shuffle=True).alias("sh"),
                    X.pick_negatives_list(F.col("id"), F.col("negatives"), 9, 0).alias("dr")).first()
    assert r["p"] == "p" and r["rr"] == ["n3", "n4", "n0"]
    assert len(set(r["sh"])) == 3 and set(r["sh"]) <= {"n0", "n1", "n2", "n3", "n4"}
    assert len(r["dr"]) == 9 and set(r["dr"]) <= {"n0", "n1", "n2", "n3", "n4"}
    ans = spark.createDataFrame([(1, "x")], "id long, prediction_text string")
    refs = spark.createDataFrame([(1, ["x"])], "id long, answers array<string>")
    p, rf = Q.format_qa(ans, refs, v2=True)
    assert p.dtypes == [("id", "string"), ("prediction_text", "string"), ("no_answer_probability", "double")]
    w = spark.createDataFrame([([0, 5, 10], [4, 9, 12], 1, 3)], "starts array<int>, ends array<int>, tok_start int, tok_end int")
    off = w.select(T.window_offsets(prefix=2, suffix=1).alias("o")).first()["o"]
    assert off[0] is None and off[1] is None and (off[2]["start"], off[3]["end"]) == (5, 12) and off[4] is None
    long = spark.createDataFrame([("PER", "f1", 0.5), ("overall", "f1", 0.7)], "type string, metric string, value double")
    assert sorted(r["metric"] for r in S.flatten_report(long).collect()) == ["PER_f1", "overall_f1"]
    assert [r["metric"] for r in S.flatten_report(long, overall_only=True).collect()] == ["overall_f1"]


def test_report_helpers(spark):
    from nluscore.operators import report as G
    long = spark.createDataFrame([("t", "en", "acc", 0.5), ("t", "fr", "acc", 0.7), ("t", "en", "f1", 0.2)],
                                 "task string, config string, metric string, value double")
    got = {(r["metric"]): r["value"] for r in G.macro_average(long, ["task"], require_all=True).collect()}
    assert got == {"acc": 0.6}                     # f1 is missing for fr, so it is not averaged
    got_all = {(r["metric"]): r["value"] for r in G.macro_average(long, ["task"]).collect()}
    assert got_all == {"acc": 0.6, "f1": 0.2}
    filled = spark.createDataFrame([("m", "t", "en", 0, 0.5), ("m", "t", "fr", 0, 0.25)],
                                   "model string, task string, lang string, metric_rank int, value double")
    row = G.language_detail(filled).first()
    assert (row["en"], row["fr"]) == (50.0, 25.0)
    spec = spark.createDataFrame([("m", "t", "sw", "acc")], "model string, task string, config string, metric string")
    res = spark.createDataFrame([("m", "t", "en", "acc", 0.9)], "model string, task string, config string, metric string, value double")
    assert G.fill_spec(spec, res, ["model", "task", "config", "metric"]).first()["value"] == 0.0


def test_discover_models_and_truncate(spark):
    from nluscore.operators import tokens as T
    res = spark.createDataFrame([("m1", "xnli", "", "acc", 0.5), ("m2", "cola", "", "mcc", 0.1)],
                                "model string, task string, config string, metric string, value double")
    assert [r["model"] for r in R.discover_models(res, "xnli").collect()] == ["m1"]
    df = spark.createDataFrame([(["a", "b", "c", "d"],)], "t array<string>")
    assert df.select(T.truncate(F.col("t"), 3, model_max=2).alias("x")).first()["x"] == ["a", "b"]


def test_missing_predictions_count_as_wrong(spark):
    from nluscore.operators import classify as C
    df = spark.createDataFrame([("a", "a"), ("b", None), ("b", "b"), ("a", None)], "gold string, pred string")
    assert C.accuracy(df, "pred", "gold").first()["accuracy"] == 0.5
    got = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in C.class_counts(C.confusion(df, "pred", "gold")).collect()}
    assert got == {"a": (1.0, 0.0, 1.0), "b": (1.0, 0.0, 1.0)}


def test_null_texts_are_one_corpus_entry(spark):
    from nluscore.operators.labels import dedupe_corpus
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "x"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["corpus_id"], r["is_first"]) for r in dedupe_corpus(df).collect()}
    assert got == {1: (0, True), 2: (1, True), 3: (0, False), 4: (1, False), 5: (2, True)}


def test_ideal_gains_per_key(spark):
    from nluscore.operators.retrieval import judged_from_qrels
    q = spark.createDataFrame([(1, 1, "a", 2), (1, 2, "a", 1), (1, 1, "b", 3), (1, 9, None, 5), (1, 3, "a", 0)],
                              "qid long, docid long, cfg string, rel int")
    got = {r["cfg"]: (r["n_rel"], r["ideal"]) for r in judged_from_qrels(q, 2, "cfg").collect()}
    assert got == {"a": (2, [2.0, 1.0]), "b": (1, [3.0]), None: (1, [5.0])}


def test_factor_of_the_spec(spark):
    from nluscore.operators import report as G
    df = spark.createDataFrame([("m", "qa", "de", 0, 80.0, 1.0), ("m", "nli", "de", 0, 0.5, 100.0)],
                               "model string, task string, lang string, metric_rank int, value double, factor double")
    assert {r["task"]: r["value"] for r in G.task_scores(df).collect()} == {"qa": 80.0, "nli": 50.0}
    assert G.language_scores(df).first()["value"] == 65.0


def test_last_token_of_an_empty_mask(spark):
    from nluscore.operators.vectors import pool_tokens
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], 0)], "t array<array<double>>, n int")
    assert pool_tokens(df, "t", "n", "last_token", "v").first()["v"] == [1.0, 2.0]


def test_drop_ignored(spark):
    rows = [([-100, 1, 2, -100], [9, 1, 3, 9]), ([1, 2], [1]), ([None, -100], [4, 5]), ([], [1]), (None, [1]), ([3], None)]
    d = spark.createDataFrame(rows, "gold array<int>, pred array<int>").select(TX.drop_ignored("gold", "pred").alias("p"))
    got = [None if r.p is None else [tuple(x) for x in r.p] for r in d.collect()]
    assert got == [[(1, 1), (2, 3)], [(1, 1), (2, None)], [(None, 4)], [], None, [(3, None)]]
