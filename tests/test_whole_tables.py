"""Queries without SQL, and parts that the SQL doesn't see, over all rows of their tables."""

import math
import random

from pyspark.sql import functions as F

from assay.operators import calibrate
from assay.plans import fixtures, registry

from .test_queries import SF


def test_calibration_experiment_runs_every_arm(spark):
    out = registry.QUERIES["calibration_experiment"](spark, SF).collect()
    sizes = {r["source"]: r["count"] for r in fixtures.predictions(spark, SF).groupBy("source").count().collect()}
    want = {(w, k, arm) for w, n in sizes.items() for k in (25, 50, 100) if n > k + 20 for arm in ("raw", "serving", "pooled", "own")}
    assert {(r["workload"], r["k"], r["arm"]) for r in out} == want and len(out) == len(want)
    assert {"orders"} <= {r["workload"] for r in out} and all(r["low"] <= r["nll"] <= r["high"] for r in out)


def test_held_out_losses_by_hand(spark):
    """Losses of rows that a sample leaves out, against a loop over rows, samples and arms; odd rows are left out."""
    rng = random.Random(3)
    vector = lambda n: [v / sum(x) for x in [[rng.random() ** 3 for _ in range(n)]] for v in x]
    rows = [(i, f"w{i % 2}", vector(2 + i % 3), i % 2, 0.7 + i % 2) for i in range(60)] + [(60, "w0", [1.0, 0.0], 1, 0.7), (61, "w1", [0.0, 1.0], 0, 1.7)]
    drawn = [(*row, 9, r) for r in range(3) for row in rows if row[0] % 7 == r]
    fits = [(w, 9, r, 0.5 + r + (w == "w1"), 1.5 + r) for w in ("w0", "w1") for r in range(3)]
    columns = "id int, workload string, p array<double>, label int, serving double"
    odd = [(70, "w0", None, 0, 1.0), (71, "w1", [0.5, 0.5], None, 1.0), (72, None, [1.0], 0, 1.0), (73, "w0", [0.5, 0.5], 5, 1.0)]
    found = calibrate.held_out_losses(spark.createDataFrame(rows + odd, columns), spark.createDataFrame(drawn, f"{columns}, k int, r int"), spark.createDataFrame(fits, "workload string, k int, r int, own double, pooled double"))
    found = {(r["workload"], r["r"], r["arm"]): r["nll"] for r in found.collect()}

    def loss(p, label, t):
        x = [max(v, 1e-12) ** (1 / t) for v in p]
        return -math.log(max(x[label] / sum(x), 1e-12))

    for w, _, r, own, pooled in fits:
        rest = [row for row in rows if row[1] == w and row[0] % 7 != r]
        for arm, t in (("raw", None), ("serving", None), ("own", own), ("pooled", pooled)):
            want = sum(loss(p, label, t or (1.0 if arm == "raw" else serving)) for _, _, p, label, serving in rest) / len(rest)
            assert abs(found.pop((w, r, arm)) - want) < 1e-9
    assert not found


def test_respond_answers_every_request(spark, monkeypatch):
    from assay.plans import serving

    events = fixtures.table(spark, SF, "events").filter("event_id < 20").withColumn("event_id", F.col("event_id") * 1000)
    monkeypatch.setattr(serving, "table", lambda *_: events)
    out = registry.QUERIES["respond"](spark, SF)
    assert {r["event_id"] for r in out.select("event_id").collect()} == {i * 1000 for i in range(20)}
