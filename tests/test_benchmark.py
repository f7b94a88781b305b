"""Reports from a specification: factors, suites, languages, missing results, models outside a folder."""

import pytest

from nluscore.operators import benchmark as B

TASKS = (B.Task("a", ("acc",), 100.0, B.languages("de,en")), B.Task("b", ("f1", "em"), 1.0, B.languages("en,fr", "b.{}")), B.Task("c", ("acc",)))


def test_report_parts(spark):
    rows = [("m1", "a", "de", "acc", 0.5), ("m1", "a", "en", "acc", 0.7), ("m1", "a", "en", "acc", 0.6), ("m1", "a", "xx", "acc", 0.9),
            ("m1", "b", "b.en", "f1", 80.0), ("m1", "b", "b.fr", "f1", 40.0), ("m1", "b", "b.en", "em", 10.0), ("m1", "c", None, "acc", 0.25),
            (None, "a", "de", "acc", 1.0), ("m3", "b", "b.en", "f1", 50.0)]
    res = spark.createDataFrame(rows, "model string, task string, config string, metric string, value double")
    held = B.held_against(res, TASKS, marker="a")
    got = {(r["model"], r["section"], r["name"]): r["value"] for r in B.report(held, {"s": ("a", "c")}).collect()}
    assert {m for m, _, _ in got} == {"m1", ""}  # m3 lacks the marker task
    assert got["m1", "task", "a-acc"] == pytest.approx(60.0) and got["m1", "task", "b-f1"] == 60.0 and got["m1", "task", "b-em"] == 5.0
    assert got["m1", "suite", "s"] == pytest.approx((60 + 25) / 2) and got["", "suite", "s"] == 25.0
    assert got["m1", "lang", "en"] == pytest.approx((70 + 80) / 2) and got["m1", "lang", "fr"] == 40.0 and got["", "lang", "de"] == 100.0
    assert got["m1", "detail", "b.fr"] == 40.0 and got["m1", "missing", "b"] == 1.0 and ("m1", "missing", "a") not in got
    assert got["", "missing", "b"] == 4.0
    wide = {r["model"]: r.asDict() for r in B.wide_table(B.task_scores(held), TASKS).collect()}
    assert list(wide["m1"]) == ["model", "avg", "a", "b", "c"] and wide["m1"]["avg"] == pytest.approx((60 + 60 + 25) / 3)
    assert B.missing(held).filter("model = 'm1'").count() == 1
    assert {r["model"] for r in B.held_against(res, TASKS).collect()} == {"m1", "", "m3"}


def test_specifications_hold_together():
    names = {t.name for t in B.MULTILINGUAL}
    assert all(set(ts) <= names for ts in B.SUITES.values()) and len({t.name for t in B.GLUE}) == 8
    assert all(len({c for c, _ in t.configs}) == len(t.configs) for t in B.MULTILINGUAL)
