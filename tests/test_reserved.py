"""Reserved tests from several sources, on small cases by hand."""

import pytest
from pyspark.sql import functions as F

from assay.functions import answers, text
from assay.operators import reserved
from assay.sources import artifacts, sinks

KIND = "source string, id string, state string, label int, place long, extra string"


def source(spark, name, states, count, width=2, labels=None):
    rows = [(name, f"{name}{i}", s, (labels or [0] * len(states))[i], i, "{}") for i, s in enumerate(states)]
    return reserved.Source(name, spark.createDataFrame(rows, KIND), width, count)


@pytest.fixture()
def reference(spark):
    held = spark.createDataFrame([("Leaked  TEXT",)], "t string").select(text.content_key(text.json_string(F.col("t"))).alias("key"))
    return held.unionByName(spark.createDataFrame([("example:reserved:b:2",)], "key string"))


def test_sources_are_read_until_they_are_full(spark, reference):
    """Leaked and repeated texts are passed over and counted up to the last row taken; what a full source leaves isn't taken."""
    a = source(spark, "a", ["one", "leaked text", "ONE ", "two", "one", "three"], 2)
    b = source(spark, "b", ["two", "three", "four", "five", "leaked text", "six"], 3, 3, [0, 2, 1, 1, 0, 2])
    examples, dropped = reserved.reserve([a, b], reference)
    got = {r["id"]: (r["row_id"], r["state"], list(r["target"])) for r in examples.collect()}
    assert got == {
        "reserved:a:0": ("a0", "one", [1, 0]), "reserved:a:3": ("a3", "two", [1, 0]),
        "reserved:b:1": ("b1", "three", [0, 0, 1]), "reserved:b:3": ("b3", "five", [0, 1, 0]), "reserved:b:5": ("b5", "six", [0, 0, 1]),
    }
    assert {r["source"]: (r["leaked"], r["duplicate"]) for r in dropped.collect()} == {"a": (1, 1), "b": (2, 1)}


def test_short_sources_and_odd_labels_fail(spark, reference):
    with pytest.raises(ValueError, match="a: only 1 of 2"):
        reserved.reserve([source(spark, "a", ["one", "One"], 2)], reference)
    with pytest.raises(ValueError, match="1 labels outside 2"):
        reserved.reserve([source(spark, "a", ["one", "two", "three"], 2, 2, [0, 2, 5])], reference)
    with pytest.raises(ValueError, match="once each"):
        reserved.reserve([source(spark, "a", ["one"], 1)] * 2, reference)


def test_label_orders(spark):
    rows = spark.createDataFrame([(0, "ham"), (1, "spam"), (0, "ham")], "i int, name string")
    reserved.check_labels(rows, "i", "name", ["ham", "spam"])
    for wrong in (["spam", "ham"], ["ham"], ["ham", "spam", "eggs"]):
        with pytest.raises(ValueError, match="order of labels"):
            reserved.check_labels(rows, "i", "name", wrong)
    with pytest.raises(ValueError, match="order of labels"):
        reserved.check_labels(rows.unionByName(spark.createDataFrame([(None, None)], "i int, name string")), "i", "name", ["ham", "spam"])


def test_nothing_is_cut_in_silence(spark):
    """Reports and artifacts of too many rows are refused; a name of any length keeps its end."""
    wide = spark.range(1001).selectExpr("id", "id as n")
    with pytest.raises(ValueError, match="1,000"):
        sinks.markdown_pivot(wide, "id")
    assert sinks.markdown_pivot(wide.limit(2), "id").count("\n") == 3
    fits = spark.range(65).selectExpr("concat('p', id) as primitive", "1.0d as temperature", "id as n", "1.0d as nll_before", "1.0d as nll_after", "false as at_bound")
    for wrong in (fits, fits.limit(1).unionByName(fits.limit(1))):
        with pytest.raises(ValueError, match="one fit"):
            artifacts.build(wrong, {})
    assert len(artifacts.build(fits.limit(3), {})["fits"]) == 3
    long = spark.createDataFrame([("src:" + "x" * 1_200_000 + "end",), ("other",), (None,)], "name string")
    found = [r[0] for r in long.select(answers.without_prefix(F.col("name"), "src:")).collect()]
    assert found == ["x" * 1_200_000 + "end", "other", None]
