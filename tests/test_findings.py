"""Findings of the third and fourth rounds: each test fails on the code before its finding was settled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import text
from assay.operators import calibrate, deciding, metrics, training
from assay.sources import readers


class Plain(calibrate.Scorer):
    """The hash scorer without prefixes."""

    def score(self, prompts, n_labels):
        return calibrate.HashScorer().score(prompts, n_labels)


def test_prompts_are_scored_where_they_are_rendered(spark):
    asked = spark.createDataFrame([("n", "noul", "Good?", None, None), ("c", "choice", "Which?", ["a", "b", "a"], [None, "x", None]), ("m", "noul", "Good?", None, None)], "qid string, type string, instructions string, names array<string>, descriptions array<string>")
    states = ['"a"', '"State JSON:\\n ü😀"', '""', None, '"' + "long " * 20_000 + '"']
    rows = spark.createDataFrame(list(enumerate(states)), "row long, state string")
    column = deciding.as_column(asked)
    for readout in (deciding.LETTERS, deciding.CANDIDATE):
        out = deciding.distributions(rows, column, calibrate.HashScorer(), readout)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()  # neither prompts nor states move
        got = {(r["row"], r["qid"]): r["p"] for r in out.select("row", "q.qid", "p").collect()}
        assert got == {(r["row"], r["qid"]): r["p"] for r in deciding.distributions(rows, column, Plain(), readout).select("row", "q.qid", "p").collect()}
        shown = rows.select("row", F.explode(column).alias("q"), "state").select("row", "q.qid", "q.type", F.size("q.keys").alias("k"), deciding.prompts(readout, F.col("state"), F.col("q")).alias("prompts")).collect()
        assert len(shown) == len(got) == 15
        for r in shown:
            single = readout == deciding.LETTERS or r["type"] == "noul"
            if states[r["row"]] is None:
                assert got[r["row"], r["qid"]] is None
                continue
            each = Plain().score(r["prompts"], [r["k"] if single else 2] * len(r["prompts"]))
            yes = [p[1] for p in each]
            want = each[0] if single else [y / sum(yes) for y in yes]
            assert max(abs(a - b) for a, b in zip(got[r["row"], r["qid"]], want)) < 1e-12


def test_contamination_learns_from_no_sample(spark):
    import random

    from assay.llm import decontam

    draw = random.Random(3)
    words = [f"w{i}" for i in range(800)]
    items = [" ".join(draw.choices(words, k=40)) for _ in range(12)]
    texts = [" ".join(draw.choices(words, k=300)) for _ in range(60)]
    for i, item in enumerate(items):
        texts[5 * i] += " " + " ".join("other" if j % 8 == 7 else w for j, w in enumerate(item.split()))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def found(shift):
        docs = spark.createDataFrame([(i + shift, t) for i, t in enumerate(texts)], "doc_id long, text string")
        return {(r["id"] - shift, r["item_id"]): r["cosine"] for r in decontam.contaminated_pairs(docs, benchmark).collect()}

    one, other = found(0), found(1_000_003)  # ids chose the sample
    assert set(one) == set(other) == {(5 * i, i) for i in range(12)}
    assert max(abs(one[k] - other[k]) for k in one) < 1e-6


def test_reserved_tests_bound_arrow_batches_and_hash_the_reference_once(spark, monkeypatch):
    from assay.operators import reserved, training

    name, made = "spark.sql.execution.arrow.maxBytesPerBatch", []
    real = reserved.materialize
    monkeypatch.setattr(reserved, "materialize", lambda df, label: made.append(label) or real(df, label))
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "67108864b")
        rows = spark.createDataFrame([(i, f"a text of number {i}", i % 2) for i in range(20)], "i long, text string, label int")
        source = lambda n: reserved.Source(n, training.scanned(rows, n, F.concat(F.col("text"), F.lit(n)), F.col("label"), ["i"], "i", 1, 100), 2, 5)
        reference = spark.createDataFrame([("content:none",), ("content:none",)], "key string")
        examples, _ = reserved.reserve([source("one"), source("two")], reference)
        assert examples.count() == 10 and made.count("reference") == 1
        assert spark.conf.get(name) == "4m"
    finally:
        spark.conf.set(name, before)


def test_json_is_parsed_once_for_all_paths(spark):
    from assay.functions import text

    texts = ['{"a":{"b":[1,{"y":1,"x":"ü"}]},"c":null}', '{"a":{}}', '{"a":3,"c":"\\ud83d\\ude00"}', "[1]", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    got = [tuple(r["x"]) for r in rows.select("i", text.json_paths(F.col("value"), {"b": ("a", "b"), "c": ("c",)}, {"s": ("a", "b")}).alias("x")).orderBy("i").collect()]
    assert got == [('[1,{"y":1,"x":"ü"}]', "null", '[1,{"x":"ü","y":1}]'), (None, None, None), (None, '"😀"', None), (None, None, None), (None, None, None)]


def test_written_files_are_of_bounded_size(spark, tmp_path, monkeypatch):
    from assay.sources import readers, sinks

    monkeypatch.setattr(sinks, "FILE_LINES", 10)
    rows = spark.range(95).coalesce(1).selectExpr("cast(id as string) as id", "'g' as group_id", "'s' as source", "'1' as state", "'noul' as type", "array('no', 'yes') as answer_keys", "array(1.0d, 0.0d) as target", "'gold' as target_origin", "'{}' as provenance", "1 as format_version")
    manifest = sinks.write_dataset({"train": rows}, f"file://{tmp_path}/data")
    files = {p.name: len(p.read_text().splitlines()) for p in (tmp_path / "data/train").glob("part-*")}
    assert set(manifest["partitions"]["train"]["files"]) == set(files) and max(files.values()) <= 10 and sum(files.values()) == 95
    lines = readers.json_lines(spark, f"file://{tmp_path}/data/train/part-*").collect()
    assert all(r["problem"] is None for r in lines) and {(r["file"].split("/")[-1], r["line_number"]) for r in lines} == {(f, i + 1) for f, n in files.items() for i in range(n)}
    assert readers.read_examples(spark, f"file://{tmp_path}/data/train/part-*").count() == 95


def test_answers_are_parsed_once_and_joined_without_distributions(spark, tmp_path):
    answer = '{{"example": "e{0}", "answers": {{"q": {{"type": "choice", "probabilities": {{"a": 0.{0}, "b": 0.5}}}}}}}}'
    for arm in ("one", "two"):
        (tmp_path / arm).mkdir()
        (tmp_path / arm / "part-0.json").write_text("\n".join(answer.format(i) for i in range(1, 10)))
    expected = spark.createDataFrame([(f"e{i}", "q", ["a"]) for i in range(1, 11)], "example string, qid string, expected array<string>")
    marks = metrics.arm_marks(expected, readers.arm_outputs(spark, f"{tmp_path}/*/part-*", whole_files=False))
    plan = marks._jdf.queryExecution().optimizedPlan().toString()
    assert "json" not in plan.lower() and "probabilities" not in plan
    table = metrics.arm_table(marks)
    copied = table._jdf.queryExecution().optimizedPlan().toString().split("Expand")[1].split("Join")[0]
    assert "Aggregate" in copied  # sums, not marks, are copied for the totals
    got = {(r["example"], r["arm"]): (r["n"], r["n_correct"], r["n_missing"]) for r in table.collect()}
    assert len(got) == 22 and got["Total", "two"] == (10, 5, 1) and got["e4", "one"] == (1, 0, 0) and got["e10", "one"] == (1, 0, 1)


def test_losses_of_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(g, (p / p.sum()).tolist(), int(rng.integers(0, n))) for g, n in (("a", 2), ("a", 7), ("b", 10)) for p in rng.random((50, n))]
    points = [(g, f"{g}{t}", t) for g in "ab" for t in (0.1, 1.0, 5.0)]
    out = calibrate.losses_at(spark.createDataFrame(rows, "g string, p array<double>, label int"), "g", spark.createDataFrame(points, "g string, point string, temperature double"))
    got = {(r["g"], r["point"]): (r["loss"], r["n"]) for r in out.collect()}
    for g, name, t in points:
        own = [np.array(p) ** (1 / t) for h, p, _ in rows if h == g]
        want = sum(min(-np.log(p[y] / p.sum()), -np.log(1e-12)) for p, y in zip(own, [y for h, _, y in rows if h == g]))
        assert abs(got[g, name][0] - want) < 1e-9 * max(1, want) and got[g, name][1] == len(own)


def test_overlong_rows_takes_texts_without_a_word(spark, tmp_path):
    import duckdb

    from assay.plans import registry

    odd = [None, "", " \t\r\n\f", "\v", " w" * 300 + "\n", "w\n" * 301, "\v".join("w" * 301), "\N{NO-BREAK SPACE}", "two \N{IDEOGRAPHIC SPACE}x"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for i, held in enumerate([rows, *[rows.filter(F.col("doc_id") == k) for k in range(len(odd))], rows.limit(0)]):
        held.coalesce(1).write.parquet(f"file://{tmp_path}/{i}/documents.parquet")
        out = registry.QUERIES["overlong_rows"](spark, f"{tmp_path}/{i}")
        assert "extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()  # no array of a text's words
        con = duckdb.connect()
        con.execute(f"create view documents as from '{tmp_path}/{i}/documents.parquet/*.parquet'")
        want = con.execute(registry.ORACLES["overlong_rows"]).fetchall()
        assert [(r["kept"], r["skipped"]) for r in out.collect()] == want
    counts = rows.select(text.n_words(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in counts] == [None, 0, 0, 1, 300, 301, 1, 1, 2]


def test_empty_prompts_fail_unless_they_are_allowed(spark):
    rows = spark.createDataFrame([(["A", "B"], n) for n in (0, 1, 10, 11)], "labels array<string>, n int")
    kept, skipped = training.within_length(rows, F.col("n"), 10, least=0)
    assert {r["n_tokens"] for r in kept.collect()} == {0, 1, 10} and skipped.first()["skipped"] == 1
    for odd, least in ((rows, 1), (rows.withColumn("n", F.lit(None).cast("int")), 0), (rows.withColumn("labels", F.array(F.lit("A"), F.lit("A"))), 0)):
        for half in training.within_length(odd, F.col("n"), 10, least=least):
            with pytest.raises(Exception, match="prompt is empty"):
                half.collect()
