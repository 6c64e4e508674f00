"""Training rows loaded from files: canonical examples under both readouts and renderers, historical prompts, and what fails."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from assay.operators import loading, training
from assay.sources import readers

EXAMPLES = [
    {"format_version": 1, "id": "a", "group_id": "g", "source": "s1", "state": {"b": 1, "a": "x"}, "question": {"type": "choice", "instructions": "Which?", "criteria": {"zebra": None, "apple": "a fruit"}}, "target": [0.25, 0.75]},
    {"format_version": 1, "id": "b", "group_id": "g", "source": "s2", "state": '{"not": "an object"}', "question": {"type": "score", "instructions": "How?", "criteria": ["poor", "fair", "good"]}, "target": [0.0, 0.5, 0.5]},
    {"format_version": 1, "id": "c", "group_id": "h", "source": "s2", "state": "plain", "question": {"type": "noul", "instructions": "So?", "criteria": {"true": "it is"}}, "target": [1.0, 0.0]},
]
OLD = [{"prompt": "Read.\n\nState:\none\n\nQuestion: two\n\nQuestion: Good?\n\nA. no", "labels": [" A", " B"], "target": [1, 3], "task": "t"}]


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_canonical_examples_are_loaded(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", EXAMPLES)
    letters = {r["id"]: r for r in readers.training_rows(spark, path).collect()}
    assert set(letters) == {"a/view/0", "b/view/0", "c/view/0"} and all(r["weight"] == 1 for r in letters.values())
    a, b, c = (letters[f"{i}/view/0"] for i in "abc")
    assert 'State JSON:\n{"b":1,"a":"x"}\n' in a["prompt"] and 'A. {"name":"zebra","description":null}\nB. {"name":"apple","description":"a fruit"}' in a["prompt"]
    assert 'State JSON:\n"{\\"not\\": \\"an object\\"}"\n' in b["prompt"] and 'C. {"name":"2","description":"good"}' in b["prompt"]
    assert b["labels"] == [" A", " B", " C"] and b["ordinal"] and not a["ordinal"] and a["task"] == "s1" and list(b["target"]) == [0, 0.5, 0.5]
    assert 'A. {"name":"no","description":null}\nB. {"name":"yes","description":"it is"}' in c["prompt"]
    assert a["leakage_keys"][1:] == ["example:a", "group:g"] and a["leakage_keys"][0].startswith("content:")
    views = {r["id"]: r for r in readers.training_rows(spark, path, readout=training.CANDIDATE).collect()}
    assert len(views) == 2 + 3 + 1 and list(views["a/view/1"]["target"]) == [0.25, 0.75] and list(views["a/view/0"]["target"]) == [0.75, 0.25]
    assert views["b/view/2"]["weight"] == pytest.approx(1 / 3) and not views["b/view/2"]["ordinal"] and views["c/view/0"]["prompt"] == c["prompt"]
    assert 'All alternatives JSON:\n{"zebra":null,"apple":"a fruit"}\n' in views["a/view/0"]["prompt"] and '"poor"' not in views["b/view/2"]["prompt"]
    old = {r["id"]: r["prompt"] for r in readers.training_rows(spark, path, loading.LEGACY).collect()}
    assert "State:\nb: 1\na: x\n" in old["a/view/0"] and "A. zebra\nB. apple: a fruit\n" in old["a/view/0"] and "A. poor\n" in old["b/view/0"] and "A. no\nB. yes: it is" in old["c/view/0"]


def test_historical_prompts_are_loaded(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", [{**OLD[0], "target": [0.25, 0.75]}])
    (row,) = readers.training_rows(spark, path).collect()
    assert row["id"].endswith("x.jsonl:1") and row["weight"] == 1 and row["renderer_version"] == loading.LEGACY and row["task"] == "t"
    state = spark.range(1).select(loading.prompt_state(F.lit(OLD[0]["prompt"]))).first()[0]
    assert state == "one\n\nQuestion: two"
    plain = readers.training_rows(spark, write(tmp_path / "y.jsonl", [{**EXAMPLES[2], "state": " ONE\n\nQuestion: two "}]))
    assert [r["key"] for r in loading.crossing(readers.training_rows(spark, path), plain).collect()] == list(row["leakage_keys"])
    for wrong in ({"readout": training.CANDIDATE}, {"renderer": loading.STRUCTURED}):
        with pytest.raises(ValueError):
            readers.training_rows(spark, path, **wrong)


@pytest.mark.parametrize(
    ("rows", "said"),
    [
        ([EXAMPLES[0], OLD[0]], "mixed"),
        ([EXAMPLES[0], EXAMPLES[0]], "duplicate id"),
        ([{**EXAMPLES[0], "format_version": 2}], "unknown format"),
        ([{**EXAMPLES[0], "target": [0.9, 0.9]}], "a: not a target"),
        ([{k: v for k, v in EXAMPLES[0].items() if k != "state"}], "a: no state"),
        ([{**EXAMPLES[1], "question": {"type": "score", "instructions": "How?", "criteria": ["x"] * 27}, "target": [1.0] + [0.0] * 26}], "more options than letters"),
        (OLD, "x.jsonl:1: not a target"),
    ],
)
def test_what_cannot_be_trained_on_fails(spark, tmp_path, rows, said):
    with pytest.raises(Exception, match=said):
        readers.training_rows(spark, write(tmp_path / "x.jsonl", rows)).collect()


def test_no_examples_make_no_rows(spark):
    kind = "id string, group_id string, source string, state string, q struct<type:string,instructions:string,keys:array<string>,told:array<string>>, target array<double>, prompt int"
    assert loading.canonical_rows(spark.createDataFrame([], kind)).columns == loading.COLUMNS
    assert not loading.canonical_rows(spark.createDataFrame([], kind)).collect()


def freeze(folder, spoil=lambda cases, said, manifest: None, after=None):
    folder.mkdir()
    cases = [{"case": f"k{e['id']}", "example": {**e, "provenance": {"gold_label": e["target"].index(max(e["target"]))}}, "request": {"state": e["state"], "questions": {"q": e["question"]}}} for e in EXAMPLES]
    keys = [["zebra", "apple"], ["0", "1", "2"], ["no", "yes"]]
    said = [{"case": c["case"], "id": c["example"]["id"], "answer_keys": k, "gold_label": c["example"]["provenance"]["gold_label"], "response": {"model": "m"}} for c, k in zip(cases, keys)]
    manifest = {"server": {"id": "m"}}
    spoil(cases, said, manifest)
    write(folder / "cases.jsonl", cases)
    write(folder / "predictions.jsonl", said)
    manifest["cases_sha256"] = hashlib.sha256((folder / "cases.jsonl").read_bytes()).hexdigest()
    (folder / "manifest.json").write_text(json.dumps(manifest))
    if after:
        after(folder)
    return str(folder)


def test_frozen_runs_are_read_with_their_pins(spark, tmp_path):
    rows = {r["case"]: r for r in readers.frozen_run(spark, freeze(tmp_path / "run"), 3).collect()}
    assert {k: (r["id"], list(r["answer_keys"]), r["gold_label"]) for k, r in rows.items()} == {"ka": ("a", ["zebra", "apple"], "1"), "kb": ("b", ["0", "1", "2"], "1"), "kc": ("c", ["no", "yes"], "0")}
    with pytest.raises(ValueError, match="of 1 to 2"):
        readers.frozen_run(spark, str(tmp_path / "run"), 2)


@pytest.mark.parametrize(
    ("spoil", "after", "said"),
    [
        (lambda c, p, m: None, lambda f: write(f / "cases.jsonl", []), "differ from the frozen manifest"),
        (lambda c, p, m: p.pop(), None, "3 cases with 3 names and 2 predictions"),
        (lambda c, p, m: c[1].update(case="ka"), None, "3 cases with 2 names"),
        (lambda c, p, m: p[0].update(answer_keys=["apple", "zebra"]), None, "ka: cases and predictions do not match"),
        (lambda c, p, m: c[2]["request"].update(state="Plain"), None, "kc: the request is not"),
        (lambda c, p, m: p[1].update(gold_label=2), None, "kb: the gold label"),
        (lambda c, p, m: m.update(server={"id": "other"}), None, "another model"),
    ],
)
def test_frozen_runs_that_were_touched_fail(spark, tmp_path, spoil, after, said):
    with pytest.raises(Exception, match=said):
        readers.frozen_run(spark, freeze(tmp_path / "run", spoil, after), 9).collect()
