"""Operators that must hold at any size: hubs, resamples, samples and fits, against plain versions of them."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay import graph
from assay.functions import render
from assay.operators import calibrate, cells, groups, permutations, prefixes, quantiles, recovery, registry, resample
from assay.sources import readers

from .test_queries import SF


def test_components_of_a_star_and_a_chain(spark):
    star = spark.range(1, 20_001).selectExpr("id * 7 as a", "0 as b")
    chain = spark.range(1000).selectExpr("-1 - id as a", "-2 - id as b")
    odd = spark.createDataFrame([(None, 5), (7, None), (3, 3), (50, 7)], "a bigint, b bigint")
    got = graph.components(star.union(chain).union(odd).repartition(8)).groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("least")).collect()
    assert {(r["component"], r["n"]) for r in got} == {(0, 20_002), (-1001, 1001)} and all(r["component"] == r["least"] for r in got)


def test_hubs_stay_where_they_are(spark):
    rows = spark.range(10_000).selectExpr("if(id % 3 = 0, 'hub', concat('k', id % 2500)) as k", "id as held", "id % 97 as v").union(spark.createDataFrame([(None, 1, 1)], "k string, held bigint, v bigint"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = graph.with_least(rows, "k", "v", "least")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["k"], r["held"], r["v"], r["least"]) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    least = {}
    for r in rows.collect():
        least[r["k"]] = min(r["v"], least.get(r["k"], r["v"]))
    assert got == sorted((r["k"], r["held"], r["v"], least[r["k"]]) for r in rows.collect() if r["k"] is not None)
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1  # only rows of light keys are shuffled


def test_groups_of_a_hot_key(spark):
    edges = spark.range(3000).selectExpr("id", "if(id % 2 = 0, 'hot', concat('own', id)) as key").union(spark.createDataFrame([(1, "x"), (5, "x"), (5, "hot")], "id bigint, key string"))
    got = Counter(r["component"] for r in groups.groups(edges).collect())
    assert got[0] == 1500 + 2 and len(got) == 1 + 1500 - 2


def test_bootstrap_counts_and_intervals(spark):
    rng = np.random.default_rng(1)
    deltas = [(f"g{i}" if i else None, int(n), int(a), float(x), float(y)) for i, (n, a, x, y) in enumerate(zip(rng.integers(1, 9, 400), rng.integers(-2, 3, 400), rng.normal(0.3, 1, 400), rng.normal(0, 1, 400)))]
    df = spark.createDataFrame(deltas, "group_id string, n bigint, d_acc bigint, d_nll double, d_brier double")
    got = {r["metric"]: r for r in resample.bootstrap(df.repartition(7), samples=300, seed="s").collect()}
    cuts = resample.poisson_cuts()
    values = np.array([d[1:] for d in deltas], float)
    weights = np.empty((300, len(deltas)))
    for i, d in enumerate(deltas):
        for r in range(300):
            digest = hashlib.sha256(f"s:{d[0] or ''}:{r // 16}".encode()).hexdigest()
            weights[r, i] = sum(int(digest[4 * (r % 16) :][:4], 16) >= c for c in cuts)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.03
    sums = weights @ values
    drawn = values[rng.integers(0, 400, (3000, 400))].sum(axis=1)  # as many groups as there are, with replacement
    for i, metric in enumerate(("acc", "nll", "brier"), 1):
        low, high = np.quantile(sums[:, i] / sums[:, 0], [0.025, 0.975])
        assert (got[metric]["low"], got[metric]["high"]) == (pytest.approx(low), pytest.approx(high)) and got[metric]["excludes_zero"] == (low > 0 or high < 0)
        plain = np.quantile(drawn[:, i] / drawn[:, 0], [0.025, 0.975])
        assert abs(low - plain[0]) < 0.2 * (plain[1] - plain[0]) and abs(high - plain[1]) < 0.2 * (plain[1] - plain[0])
    assert {r["metric"] for r in resample.bootstrap(df.limit(1), samples=40).collect()} == {"acc", "nll", "brier"}
    assert resample.bootstrap(df.limit(0)).collect() == []


def test_samples_are_the_first_in_seeded_order(spark):
    rows = [(f"i{i}", ["a", "b", None][min(2, i // 400)], i % 7) for i in range(900)] + [("i1", "a", 99), ("few", "c", 0)]
    df = spark.createDataFrame(rows, "id string, source string, _cut int")
    got = sorted((r["source"] or "", r["r"], r["id"], r["_cut"]) for r in resample.sample_k(df.repartition(5), ["source"], "id", k=9, repeats=12, seed="q").collect())
    want = []
    for source in ("a", "b", None, "c"):
        own = [r for r in rows if r[1] == source]
        for r in range(12):
            key = lambda x: hashlib.sha256(":".join(["q", *([source] if source else []), str(r), x[0]]).encode()).hexdigest()  # noqa: B023, E731
            first = sorted(own, key=key)[:9]
            want += [(source or "", r, i, c) for i, _, c in first]
    pairs = lambda x: sorted(t[:3] for t in x)
    assert pairs(got) == pairs(want) and resample.sample_k(df.limit(0), ["source"], "id", 3, 2).collect() == []


def golden(p, label, lower=0.05, upper=20.0):
    logs = np.log(np.maximum(p, 1e-12))

    def loss(u):
        z = logs / math.exp(u)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.minimum(-(z[np.arange(len(p)), label] - np.log(np.exp(z).sum(axis=1))), -math.log(1e-12)).mean())

    a, b, ratio = math.log(lower), math.log(upper), (math.sqrt(5) - 1) / 2
    for _ in range(80):
        x, y = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, y) if loss(x) < loss(y) else (x, b)
    return min([a, b, (a + b) / 2, 0.0], key=loss), loss


@pytest.mark.parametrize(("bump", "spread"), [(0.1, 4), (2.0, 4), (1.0, 0.3), (6.0, 8), (-3.0, 2), (30.0, 1)])
def test_fits_agree_with_golden_section(bump, spread):
    rng = np.random.default_rng(int(bump * 10) + 100)
    label = rng.integers(0, 5, 300)
    z = spread * rng.random((300, 5))
    z[np.arange(300), label] += bump * (rng.random(300) < 0.8)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    u, loss = golden(p, label)
    found = math.log(calibrate.fit_one(p, label))
    # golden section knows a minimum no better than the square root of a double's precision
    assert abs(found - u) < 1e-6 or loss(found) <= loss(u) + 1e-14


def test_fits_of_groups_take_few_passes(spark, monkeypatch):
    from assay.plans import fixtures
    from assay.storage import materialize

    rows = materialize(fixtures.predictions(spark, SF).select("primitive", "label", "p"), "fit_rows")
    passes, plain = [], calibrate._evaluate
    monkeypatch.setattr(calibrate, "_evaluate", lambda *a: passes.append(1) or plain(*a))
    fits = {r["primitive"]: r for r in calibrate.fit_temperatures(rows).collect()}
    assert len(passes) <= 8
    for name, fit in fits.items():
        own = rows.filter(F.col("primitive") == name).collect()
        u, loss = golden(np.array([r["p"] for r in own]), np.array([r["label"] for r in own]))
        assert math.log(fit["temperature"]) == pytest.approx(u, abs=1e-6)
        assert (fit["nll_before"], fit["nll_after"], fit["n"], fit["at_bound"]) == (pytest.approx(loss(0.0)), pytest.approx(loss(u)), len(own), False)
    even = spark.createDataFrame([("g", 0, [0.5, 0.5])] * 3, "primitive string, label int, p array<double>")
    flat, bounded = calibrate.fit_temperatures(even).first(), calibrate.fit_temperatures(rows, lower=30.0, upper=40.0).collect()
    assert flat["temperature"] == 1 and all(abs(r["temperature"] - 30) < 1e-6 and r["at_bound"] and r["nll_before"] < r["nll_after"] for r in bounded)
    assert calibrate.fit_temperatures(even.limit(0)).collect() == []


def test_shared_prefixes_do_not_depend_on_partitions(spark):
    stem = ["é" * 150 + "日本" * 40, "é" * 150 + "日本" * 40 + "x", "z" * 300]
    prompts = sorted({stem[i % 3] + f"{i // 3:03}" for i in range(200)} | {"", "é", "z" * 300})
    df = spark.createDataFrame([(p, 3) for p in prompts] * 2 + [(None, 3)], "prompt string, n_labels int")
    want, at, run = {}, 0, 0
    for i, p in enumerate(prompts):
        shared = next((k for k, (a, b) in enumerate(zip(p, prompts[i - 1])) if a != b), min(len(p), len(prompts[i - 1]))) if i else 0
        run = i if shared < 200 else run
        want[p] = (i, shared, run + (i - run) // 5 * 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = prefixes.shared_groups(df, limit=5).collect()
            assert {r["prompt"]: (r["at"], r["shared"], r["grp"]) for r in got} == want and len(got) == len(prompts)
            for r in got:
                own = [p for p in prompts if want[p][2] == r["grp"]]
                assert r["members"] == len(own) and all(p[: r["prefix"]] == own[0][: r["prefix"]] for p in own) and r["prefix"] < max(1, min(map(len, own)))
            scored = {r["prompt"]: r["p"] for r in prefixes.score_shared(df, calibrate.HashScorer(), limit=5).collect()}
            alone = {r["prompt"]: r["p"] for r in calibrate.score_views(df.filter("prompt is not null").distinct(), calibrate.HashScorer()).collect()}
            assert scored == alone and len(scored) == len(prompts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert prefixes.shared_groups(df.limit(0)).collect() == []


def test_recovered_phrasings_are_the_only_ones(spark):
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    table = spark.createDataFrame([("a", "choice", "Q one?"), ("b", "choice", "Q two?"), ("c", "choice", "Q two?"), ("d", "score", "Q one?"), ("e", "choice", "odd\n\nQuestion: in it")], "phrasing string, type string, instructions string")
    table = table.withColumns({"names": lits("no", "yes"), "descriptions": lits("", "fine")})
    states = ["plain", "", "State:\n and\n\nQuestion: in it", "x" * 3_000_000]
    asked = spark.createDataFrame([(s, a, k) for s in states for a, k in (("Q one?", "choice"), ("Q one?", "score"), ("Q two?", "choice"), ("Q three?", "choice"), ("odd\n\nQuestion: in it", "choice"))], "s string, ask string, kind string")
    prompt = F.when(F.col("kind") == "score", render.legacy_score(F.col("s"), F.col("ask"), lits("no", "yes"))).otherwise(render.legacy_choice(F.col("s"), F.col("ask"), lits("no", "yes"), lits("", "fine")))
    rows = asked.withColumns({"prompt": prompt, "labels": render.labels(F.lit(2))})
    got = recovery.recover(rows, table).collect()
    assert len(got) == 20
    for r in got:
        want = {("Q one?", "choice"): ("a", None), ("Q one?", "score"): ("d", None), ("Q two?", "choice"): (None, "ambiguous")}.get((r["ask"], r["kind"]), (None, "unmatched"))
        assert (r["phrasing"], r["reason"]) == want and r["state"] == (r["s"] if want[0] else None)
    odd = spark.createDataFrame([(None, [" A", " B"]), ("no frame at all", [" A", " B"]), ("State:\nx", None)], "prompt string, labels array<string>")
    assert [r["reason"] for r in recovery.recover(odd, table).collect()] == ["no frame"] * 3
    other = recovery.recover(rows.withColumn("labels", render.labels(F.lit(3))), table)
    assert other.filter("reason is null").count() == 0


def test_numbers_within_groups(spark):
    rows = [(i, ["hot", "hot", "b", None][i % 4]) for i in range(300)]
    got = {r["id"]: r["n"] for r in resample.numbered(spark.createDataFrame(rows, "id int, g string").repartition(5), "g", ["id"], "n").collect()}
    want = {}
    for g in ("hot", "b"):
        want |= {i: n for n, i in enumerate(i for i, x in rows if x == g)}
    assert got == want


def test_exact_percentiles(spark):
    rng = np.random.default_rng(2)
    values = {"even": rng.random(501).tolist(), "ties": [1.0] * 400 + [2.0] * 3, "wide": (rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)).tolist(), "signs": [-0.0, 0.0, -1.5, 1.5, float("-inf"), float("inf")], "one": [7.25]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("even", None), (None, 3.0), ("none", None)]
    shares = [0.0, 0.025, 0.5, 0.95, 1.0]
    got = {(r["g"], r["share"]): r["value"] for r in quantiles.exact_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", shares).collect()}
    assert set(got) == {(g, s) for g in values for s in shares}
    for (g, s), v in got.items():
        own, at = sorted(values[g]), s * (len(values[g]) - 1)
        low, high = own[math.floor(at)], own[math.ceil(at)]
        want = low if at == math.floor(at) else low + (high - low) * (at - math.floor(at))
        assert v == pytest.approx(want, rel=1e-12) or (math.isnan(v) and math.isnan(want))
    assert quantiles.exact_percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", shares).collect() == []


def test_orders_are_numbered_and_undone(spark):
    out = spark.range(24).select(F.col("id"), permutations.order_of(F.col("id"), F.lit(4)).alias("order")).collect()
    assert out[0]["order"] == [0, 1, 2, 3] and len({tuple(r["order"]) for r in out}) == 24 and all(sorted(r["order"]) == [0, 1, 2, 3] for r in out)
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 16 + 1).cast("int").alias("k")).withColumn("code", permutations.other_code("s", F.col("k"), "id"))
    rows = rows.filter("k <= 15").withColumn("order", permutations.order_of(F.col("code"), F.col("k"))).withColumn("v", F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: i * 1.5))
    for r in rows.withColumn("back", permutations.realigned(permutations.presented(F.col("v"), F.col("order")), F.col("order"))).collect():
        assert r["back"] == r["v"] and (r["order"] == list(range(r["k"]))) == (r["k"] == 1) and sorted(r["order"]) == list(range(r["k"]))
    assert spark.range(1).select(permutations.other_code("s", F.lit(16), "id").alias("c")).first()["c"] is None


def test_cells_follow_the_weights(spark):
    axes = {"a": {f"v{i}": w for i, w in enumerate((1, 5, 0, 2, 9, 3))}, "b": {"x": 7, "y": 1}, "c": {"only": 4}, "d": {f"{i}": 1 + i for i in range(300)}, "e": {f"{i}": 1_000_003 for i in range(7)}}
    n = 100_000
    out = cells.draw(spark.range(n), "id", axes, "s").cache()
    for name, values in axes.items():
        got = {r[name]: r["count"] for r in out.groupBy(name).count().collect()}
        want = {v: n * w / sum(values.values()) for v, w in values.items() if w}
        assert set(got) == set(want)
        chi = sum((got[v] - w) ** 2 / w for v, w in want.items())
        assert chi < len(want) + 5 * math.sqrt(2 * len(want)) + 5
    pairs = {(r["a"], r["b"]): r["count"] for r in out.groupBy("a", "b").count().collect()}
    assert all(abs(k - n * axes["a"][a] * axes["b"][b] / 160) < 6 * math.sqrt(n * axes["a"][a] * axes["b"][b] / 160) + 5 for (a, b), k in pairs.items())
    with pytest.raises(ValueError):
        cells.alias_table([0, 0])


def test_versions_in_force_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    events = [(i, ["hot", "b", "c", None][min(3, int(rng.integers(0, 9)) // 3 * (i % 7 == 0))], int(t) if i % 50 else None) for i, t in enumerate(rng.integers(0, 400, 1500))] + [(1, "b", 5), (1, "b", 5)]
    versions = [(k, int(t), f"{k}{t}{x}") for k in ("hot", "b", "late") for t in rng.integers(100, 500, 6) for x in "ab"] + [(None, 3, "n"), ("c", None, "n")]
    e, v = spark.createDataFrame(events, "side int, workload string, ts int"), spark.createDataFrame(versions, "workload string, ts int, version string")
    want = sorted((i, k or "", t or -1, max(((vt, x) for vk, vt, x in versions if k and t is not None and vk == k and vt is not None and vt <= t), default=(0, ""))[1]) for i, k, t in events)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "5", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = sorted((r["side"], r["workload"] or "", r["ts"] or -1, r["version"] or "") for r in registry.in_force(e, v).collect())
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["workload"] for r in registry.admitted(v.filter("workload is not null and ts is not null"), 2).collect()} <= {"hot", "b", "late"}
    assert registry.in_force(e.limit(0), v).collect() == []


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = [f'{{"n": {i}, "pad": "{"é" * (i % 50)}"}}' if i % 9 else "" for i in range(1, 801)]
    lines[616] = '{"a": NaN}'
    (tmp_path / "a.jsonl").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.jsonl").write_bytes("\r\n".join(lines[:300]).encode() + b"\r\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        rows = readers.json_lines(spark, f"{tmp_path}/*.jsonl").collect()
        splits = spark.read.text(f"{tmp_path}/a.jsonl").select("_metadata.file_block_start").distinct().count()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert splits > 5
    for name, n in (("a", 800), ("b", 300)):
        got = {r["line_number"]: r["value"] for r in rows if r["file"].endswith(f"{name}.jsonl")}
        assert got == {i: x for i, x in enumerate(lines[:n], 1) if x}
    assert [(r["line_number"], r["problem"]) for r in rows if r["problem"]] == [(617, "NaN is not a number")]
