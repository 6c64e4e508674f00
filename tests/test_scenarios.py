"""Answers of several arms read from files, and validators of generated scenarios, on small cases by hand."""

import json

import pytest
from pyspark.sql import functions as F

from assay.operators import filters, metrics, training
from assay.sources import readers


def test_arms_are_read_and_marked(spark, tmp_path):
    """One file an example; ties fall to the option that stands first in the file, one half is yes, gaps have no mark."""
    yes, no = {"type": "noul", "noul": 0.5}, {"type": "noul", "noul": 0.4999}
    tie = {"type": "choice", "probabilities": {"zebra": 0.4, "apple": 0.4, "fig": 0.2}}
    level = {"type": "score", "probabilities": {"0": 0.1, "1": 0.2, "2": 0.7}}
    odd = {"type": "essay", "noul": 0.9}
    held = {"small": {"one": {"a": yes, "b": tie}, "two": {"a": level}}, "large=b": {"one": {"a": no, "b": odd}, "two": {}}}
    for arm, examples in held.items():
        (tmp_path / arm).mkdir()
        for name, answers in examples.items():
            (tmp_path / arm / f"{name}.json").write_text(json.dumps({"answers": answers}, indent=1))
    want = [("one", "a", ["true"]), ("one", "b", ["zebra"]), ("two", "a", ["1", "2"])]
    expected = spark.createDataFrame(want, "example string, qid string, expected array<string>")
    marks = metrics.arm_marks(expected, readers.arm_outputs(spark, f"{tmp_path}/*/*.json"))
    assert {(r["arm"], r["example"], r["qid"]): r["correct"] for r in marks.collect()} == {
        ("small", "one", "a"): True, ("small", "one", "b"): True, ("small", "two", "a"): True,
        ("large=b", "one", "a"): False, ("large=b", "one", "b"): None, ("large=b", "two", "a"): None,
    }
    table = {(r["example"], r["arm"]): (r["n"], r["n_correct"], r["n_missing"]) for r in metrics.arm_table(marks).collect()}
    assert table["Total", "small"] == (3, 3, 0) and table["Total", "large=b"] == (3, 0, 2) and table["two", "large=b"] == (1, 0, 1) and len(table) == 6


def test_many_arms_are_refused(spark):
    rows = spark.range(101).selectExpr("concat('arm', id) as arm", "'e' as example", "'q' as qid", "'noul' as type", "0.5D as noul", "cast(null as map<string, double>) as probabilities")
    with pytest.raises(ValueError):
        metrics.arm_marks(spark.createDataFrame([("e", "q", ["true"])], "example string, qid string, expected array<string>"), rows)


def test_scenario_problems_by_hand(spark):
    three = ["a", "b", "c"]
    cases = [
        ("choice", "choice", three, "b", '"text"', "short", None),
        ("noul", "choice", three, "b", '"text"', "short", "primitive mismatch"),
        (None, "choice", three, "b", '"text"', "short", "primitive mismatch"),
        ("choice", "choice", three, "d", '"text"', "short", "expected not among options"),
        ("choice", "choice", three, None, '"text"', "short", "expected not among options"),
        ("choice", "choice", ["a", "b"], "b", '"text"', "short", "choice option count out of range"),
        ("choice", "choice", [str(i) for i in range(27)], "3", '"text"', "short", "choice option count out of range"),
        ("choice", "choice", [], "3", '"text"', "short", "invalid question"),
        ("score", "score", three, "2", "{}", "long", None),
        ("score", "score", three, "3", "{}", "long", "expected level out of range"),
        ("score", "score", three, "true", "{}", "long", "expected level out of range"),
        ("score", "score", three, "1.0", "{}", "long", "expected level out of range"),
        ("noul", "noul", None, "false", "[1]", "medium", None),
        ("noul", "noul", None, "1", "[1]", "medium", "expected must be a boolean"),
        ("noul", "noul", None, "true", "7", "medium", "state must be a string, object, or array"),
        ("noul", "noul", None, "true", None, "medium", "state must be a string, object, or array"),
        ("noul", "noul", None, "true", "{}", "huge", "unknown tier"),
        ("noul", "noul", None, "true", '"' + "日" * 498 + '"', "short", None),
        ("noul", "noul", None, "true", '"' + "日" * 499 + '"', "short", "state too long for its tier"),
    ]
    names = ["kind", "wanted", "options", "expected", "state", "tier"]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, kind string, wanted string, options array<string>, expected string, state string, tier string, want string")
    found = rows.withColumn("problem", filters.scenario_problem(*[F.col(c) for c in names])).orderBy("i").collect()
    assert [r["problem"] for r in found] == [c[-1] for c in cases]


def test_legacy_conversion_by_hand(spark):
    """Labels of every loose form; what can't be converted stays, with a problem and no values."""
    three = ["a", "b", "c"]
    cases = [
        ("choice", three, '"b"', 1, None), ("choice", three, "2", 2, None), ("choice", three, '"2"', None, "label names no option"), ("choice", three, "3", None, "label names no option"),
        ("choice", three, "true", 1, None), ("choice", three, None, None, "label names no option"), ("choice", [str(i) for i in range(27)], "1", None, "more options than letters"),
        ("score", three, "1", 1, None), ("score", three, '"1"', 1, None), ("score", three, "1.7", 1, None), ("score", three, '"1.7"', None, "label names no option"), ("score", three, "-1", None, "label names no option"),
        ("noul", None, "true", 1, None), ("noul", None, '"yes"', 1, None), ("noul", None, "1", 1, None), ("noul", None, '"true"', 1, None), ("noul", None, '"Yes"', 0, None), ("noul", None, None, 0, None),
        (None, three, "1", None, "unknown type"),
    ]
    rows = spark.createDataFrame([(i, "s", "Fit?", None, "src", *c[:3]) for i, c in enumerate(cases)], "i int, state string, instructions string, descriptions array<string>, src string, type string, names array<string>, label string")
    found = training.legacy_converted(rows, "old").orderBy("i").collect()
    assert [(r["target_index"], r["problem"]) for r in found] == [c[3:] for c in cases]
    for r in found:
        if r["problem"]:
            assert r["prompt"] is None and r["labels"] is None and r["target"] is None and r["task"] is None
        else:
            assert r["labels"] == [" A", " B", " C"][: len(r["target"])] and r["target"].index(1.0) == r["target_index"] and sum(r["target"]) == 1 and r["task"] == "old:src" and "State:\ns\n" in r["prompt"]
