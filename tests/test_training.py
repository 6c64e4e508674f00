"""Failures and odd rows of training rows, answers, quotas, pairs, late events and legacy text."""

import pytest
from pyspark.sql import functions as F

from assay.functions import answers, prob, text
from assay.operators import pairing, resample, training
from assay.plans import fixtures
from assay.streaming import requests, windows


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_first_brace_only(spark):
    cases = {'say {"a": {"b": "}"}} end': '{"a":{"b":"}"}}', 'a { b } and {"a":1}': None, "no brace": None, '{"a":1': None, '{"a":NaN}': None, '{"a":1,"a":2}': '{"a":2}'}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.balanced_object(F.col("t")).alias("o"))
    assert {r["t"]: r["o"] for r in df.collect()} == cases


def test_flattened_states_print_as_python(spark):
    cases = {'{"a":true,"b":null,"c":[1,"x"],"d":{"e":1.5}}': "a: True\nb: None\nc: [1, 'x']\nd: {'e': 1.5}", '"plain"': "plain", '["x",null]': "['x', None]", "{}": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.flatten_state(F.col("t")).alias("o"))
    assert {r["t"]: r["o"] for r in df.collect()} == cases


def test_confidence_without_mass(spark):
    p = F.col("p")
    for f in prob.CONFIDENCE.values():
        assert one(spark, f(p), p=[0.0]) == 1 and one(spark, f(p), p=[0.0, 0.0]) == 0
        assert one(spark, f(p), p=[2.0, 6.0]) == pytest.approx(one(spark, f(p), p=[0.25, 0.75]))


def test_cold_priors_cost_by_question(spark):
    rows = spark.createDataFrame([(1, 10, 8, True, 10), (2, 10, 8, True, 2), (3, 10, 8, True, 99)], "id int, n_questions int, n_options int, has_state boolean, n_cold int")
    out = {r["id"]: r["reject_reason"] for r in requests.admit(rows, requests.Limits(views=250), cold=3).collect()}
    assert out == {1: "too many views", 2: None, 3: "too many views"}
    assert requests.admit(rows.drop("n_cold"), requests.Limits(views=319), cold=3).filter("reject_reason is null").count() == 0
    assert requests.admit(rows.drop("n_cold"), requests.Limits(views=320), cold=3).filter("reject_reason is null").count() == 3


def test_pairs_need_equal_targets(spark):
    rows = fixtures.scored(spark.createDataFrame([("a", "g", "s", "choice", 3, 1), ("b", "g", "s", "choice", 3, 2)], "id string, group_id string, source string, primitive string, k int, label int"))
    assert pairing.pair_runs(rows, rows).count() == 2
    other = rows.withColumn("t", F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)))
    spoiled = rows.withColumn("p", F.transform("p", lambda v: 2 * v))
    for bad in (other, spoiled):
        with pytest.raises(Exception, match="same examples"):
            pairing.pair_runs(rows, bad).select("label").collect()


def test_disjoint_quota_is_greedy(spark):
    rows = spark.createDataFrame([(f"{i}", "a" if i < 60 else "b", [f"k{i % 7}", f"m{i % 11}"]) for i in range(100)], "id string, source string, keys array<string>")
    got = {r["id"] for r in resample.disjoint_quota(rows, ["source"], "id", "keys", 3).collect()}
    import hashlib

    want, seen = set(), set()
    for source in "ab":
        found = 0
        for r in sorted((r for r in rows.collect() if r["source"] == source), key=lambda r: hashlib.sha256(f"42:{r['id']}".encode()).hexdigest()):
            if found < 3 and not seen & set(r["keys"]):
                want.add(r["id"])
                seen |= set(r["keys"])
                found += 1
    assert got == want


def test_frozen_runs_must_be_whole(spark):
    cases = spark.createDataFrame([(0, "a"), (1, "b")], "position int, id string")
    good = cases.withColumn("model_version", F.lit("v1"))
    assert training.aligned(cases, good, 2, "v1").count() == 2
    for predicted, most, version in ((good.limit(1), 2, None), (good, 1, None), (good.withColumn("id", F.lit("a")), 2, None), (good, 2, "v2"), (good, 0, None)):
        with pytest.raises(Exception):
            training.aligned(cases, predicted, most, version).collect()


def test_training_rows_are_checked(spark):
    rows = spark.createDataFrame([(1, ["A", "B"], 5), (None, ["A", "B"], 50)], "format_version int, labels array<string>, n int")
    with pytest.raises(ValueError):
        training.one_format(rows)
    kept, skipped = training.within_length(rows, F.col("n"), 10)
    assert kept.count() == 1 and skipped.first()["skipped"] == 1
    with pytest.raises(Exception):
        training.within_length(rows.withColumn("labels", F.array(F.lit("A"), F.lit("A"))), F.col("n"), 10)[0].collect()


def test_titles(spark):
    rows = spark.createDataFrame([(" a ", "b\n"), ("", "b"), (None, None), ("a", "  ")], "t string, c string")
    assert [r["x"] for r in rows.select(answers.titled(F.col("t"), F.col("c")).alias("x")).collect()] == ["a\nb", "b", "", "a"]


def test_late_events_are_dropped(spark, tmp_path):
    """A file a batch; the fourth holds a row of a window that the watermark had closed in the batch before."""
    import time

    for i, hours in enumerate([["10:10", "10:20"], ["15:00"], ["15:10"], ["10:30", "14:30"], ["16:00"]]):
        rows = spark.createDataFrame([(f"2024-01-01 {h}:00", "x", 1.0) for h in hours], "ts string, event_type string, value double")
        rows.select(F.to_timestamp("ts").alias("ts"), "event_type", "value").toPandas().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"{i}.parquet")
        time.sleep(1.1)
    out = {r["start"].hour: r["n"] for r in windows.run_to_end(spark, f"file://{tmp_path}", "1 hour", files=1).collect()}
    assert out == {10: 2, 14: 1, 15: 2, 16: 1}
