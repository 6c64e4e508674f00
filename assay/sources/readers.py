"""Readers: strict JSON lines with file and line, verified files, canonical examples, wrapped texts, answers by arm.

Bad input fails with its place, or is set aside with a reason; it is never skipped in silence.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.functions import prob, text
from assay.operators import loading, training
from assay.storage import bounded_batches, materialize

CANONICAL = "id string, group_id string, source string, state string, type string, answer_keys array<string>, target array<double>, original_target array<double>, target_origin string, provenance string, format_version int"


def _placed(check: bool):
    """Rows with their place in their split, and with ``check`` what is wrong with them: a task reads a split's lines in order, one split after another."""

    def problem(line: str) -> str | None:
        if not line.strip(" "):
            return None
        try:
            text.parse(line)
        except text.JSONRejected as e:
            return str(e)
        return None if line.lstrip(" ").startswith("{") else "not an object"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n = None, 0
        for batch in batches:
            starts = pc.or_(pc.not_equal(batch.column(0)[1:], batch.column(0)[:-1]), pc.not_equal(batch.column(1)[1:], batch.column(1)[:-1])).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(starts) + 1).tolist(), batch.num_rows]
            places = np.empty(batch.num_rows, np.int64)
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    now = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                    split, n = now, n if now == split else 0
                    places[a:b] = np.arange(n + 1, n + 1 + b - a)
                    n += b - a
            found = [pa.array([problem(line) for line in batch.column(2).to_pylist()], pa.string())] if check else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places), *found], [*batch.schema.names, "place", *["problem"] * check])

    return run


def numbered_lines(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """(file, line_number, value) of every line, numbered from 1, of files of any size; with ``check`` also ``problem``, what isn't strict JSON in it.

    A file is read in splits. Lines are counted for each split first; a line's number is its place in its
    split and the lines of the splits before. Lines end as they do in text files anywhere: LF, CR LF or CR.
    """
    bounded_batches(spark)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = raw.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    lines = raw.mapInArrow(_placed(check), "file string, block bigint, value string, place bigint" + ", problem string" * check)
    return lines.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("place")).alias("line_number"), "value", *["problem"] * check)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, value, problem): every line that isn't blank. A line is numbered and parsed in one pass."""
    return numbered_lines(spark, path, check=True).filter(F.trim("value") != "")


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """Lines as JSON strings; the job fails at the first bad line, and an empty data set is an error."""
    rows = json_lines(spark, path)
    if not spark.read.text(path).filter(F.trim("value") != "").limit(1).count():
        raise ValueError(f"{path}: no rows")
    message = F.concat("file", F.lit(":"), F.col("line_number").cast("string"), F.lit(": "), "problem")
    return rows.select("file", "line_number", F.when(F.isnull("problem"), F.col("value")).otherwise(F.raise_error(message)).alias("value"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Canonical examples with normalised targets; ids must be unique and the format known."""
    parsed = materialize(read_strict(spark, path).select(F.from_json("value", CANONICAL, {"mode": "FAILFAST"}).alias("e")).select("e.*"), "examples")  # lines are parsed once
    if bad := parsed.groupBy("id").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"duplicate id {bad[0]['id']}")
    fine = prob.target_normalised(F.col("target"), F.size("answer_keys"))
    checked = F.when(F.col("format_version") != 1, F.raise_error(F.lit("unknown format"))).when(fine.isNull(), F.raise_error(F.concat(F.lit("bad target of "), "id"))).otherwise(fine)
    return parsed.withColumn("original_target", F.coalesce("original_target", "target")).withColumn("target", checked)


def question_parts(question: Column) -> Column:
    """A question's JSON (type, instructions, criteria) as a struct (type, instructions, keys, told), options in their order."""
    q = F.from_json(question, "type string, instructions string, criteria string", {"mode": "FAILFAST"})
    named, levels = F.from_json(q["criteria"], "map<string,string>"), F.from_json(q["criteria"], "array<string>")
    kind, lacking = q["type"], F.lit(None).cast("string")
    either = F.array(F.coalesce(F.element_at(named, F.lit("false")), lacking), F.coalesce(F.element_at(named, F.lit("true")), lacking))
    told = F.when(kind == "noul", either).when(kind == "score", levels).otherwise(F.map_values(named))
    numbers = F.transform(levels, lambda _, i: i.cast("string"))
    keys = F.when(kind == "noul", F.array(F.lit("no"), F.lit("yes"))).when(kind == "score", numbers).otherwise(F.map_keys(named))
    return F.struct(kind.alias("type"), q["instructions"].alias("instructions"), keys.alias("keys"), told.alias("told"))


def training_rows(spark: SparkSession, path: str, renderer: str | None = None, readout: str = training.LETTERS) -> DataFrame:
    """JSON-lines files as training rows: canonical examples with their questions, or historical prompts; never both in one data set."""
    flat = "id string, group_id string, source string, target array<double>, format_version int, prompt string, labels array<string>, task string"
    lines = read_strict(spark, path).withColumn("e", F.from_json("value", flat, {"mode": "FAILFAST"}))
    # a record is canonical if it has a version at all, and only the first version is known
    lines = lines.withColumn("versioned", text.json_field(F.col("value"), "format_version"))
    if not training.one_format(lines, "versioned").filter("versioned is not null").limit(1).count():
        return loading.legacy_rows(lines.select("file", "line_number", "e.prompt", "e.labels", "e.target", "e.task"), renderer, readout)
    held = lines.select("e.*", "versioned", text.json_field(F.col("value"), "state").alias("state"), text.json_field(F.col("value"), "question").alias("question"))
    if bad := held.groupBy("id").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"duplicate id {bad[0]['id']}")
    fine = F.when(F.col("versioned") == "1", F.col("id")).otherwise(F.raise_error(F.lit("unknown format")))
    return loading.canonical_rows(held.select(fine.alias("id"), "group_id", "source", "state", question_parts(F.col("question")).alias("q"), "target"), renderer or loading.STRUCTURED, readout)


def frozen_run(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(case, id, answer_keys, gold_label, response) of a frozen run under ``path``, or an error where it isn't what its manifest says.

    ``manifest.json`` names the model (``server.id``) and pins the files of ``cases.jsonl`` (``cases_sha256``: one hash, or
    one for each file); they are hashed before and after reading. There are 1 to ``most`` cases, each once, with a
    prediction each in ``predictions.jsonl``. A prediction has its case's example, options and gold label, and comes
    from the model; the request holds the example's state and question. Values are compared without the order of
    their keys. Both sides meet by case, not by line.
    """
    if most < 1:
        raise ValueError("the number of requests must be positive")
    manifest = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])

    def pinned() -> None:
        found, want = {r["file"]: r["sha256"] for r in file_hashes(spark, f"{path}/cases.jsonl").collect()}, manifest["cases_sha256"]
        if (found != want) if isinstance(want, dict) else (list(found.values()) != [want]):
            raise ValueError("the cases differ from the frozen manifest")

    pinned()
    plain = lambda c: F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]
    # a line is parsed once for all its fields
    kept = {"case": ("case",), "id": ("example", "id"), "question": ("example", "question"), "gold_label": ("example", "provenance", "gold_label")}
    held = {"own_state": ("example", "state"), "own_question": ("example", "question"), "state": ("request", "state"), "questions": ("request", "questions")}
    cases = read_strict(spark, f"{path}/cases.jsonl").select(text.json_paths(F.col("value"), kept, held).alias("c")).select("c.*")
    or_null = lambda c: F.coalesce(c, F.lit("null"))
    same = (or_null("state") == or_null("own_state")) & (or_null("questions") == F.concat(F.lit('{"q":'), "own_question", F.lit("}")))
    cases = cases.select(plain("case").alias("case"), plain("id").alias("id"), question_parts(F.col("question"))["keys"].alias("answer_keys"), "gold_label", same.alias("same"))
    fields = {"case": ("case",), "id": ("id",), "keys": ("answer_keys",), "gold_label": ("gold_label",), "model": ("response", "model"), "response": ("response",)}
    said = read_strict(spark, f"{path}/predictions.jsonl").select(text.json_paths(F.col("value"), fields).alias("p")).select("p.*")
    said = said.select(plain("case").alias("case"), plain("id").alias("own_id"), F.from_json("keys", "array<string>").alias("own_keys"), F.col("gold_label").alias("own_label"), plain("model").alias("model"), "response")
    cases, said = materialize(cases, "cases"), materialize(said, "predictions")
    pinned()
    n, m, named = cases.limit(most + 1).count(), said.limit(most + 1).count(), cases.select("case").distinct().limit(most + 1).count()
    if not 1 <= n <= most or n != m or n != named:
        raise ValueError(f"{n} cases with {named} names and {m} predictions, of 1 to {most}")
    both = cases.join(said, "case", "full")
    problem = (
        F.when(F.isnull("id") | ~F.coalesce((F.col("id") == F.col("own_id")) & (F.col("answer_keys") == F.col("own_keys")), F.lit(False)), "cases and predictions do not match")
        .when(~F.coalesce(F.col("same"), F.lit(False)), "the request is not the example's")
        .when(~F.col("gold_label").eqNullSafe(F.col("own_label")), "the gold label has changed")
        .when(~F.coalesce(F.col("model") == F.lit(manifest["server"]["id"]), F.lit(False)), "another model answered")
    )
    name = F.when(problem.isNull(), F.col("case")).otherwise(F.raise_error(F.concat(F.coalesce("case", F.lit("?")), F.lit(": "), problem)))
    return both.select(name.alias("case"), "id", "answer_keys", "gold_label", "response")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, verdict): each manifest entry (file, sha256, records) against what is there."""
    found = file_hashes(spark, path).select("file", F.col("sha256").alias("actual"))
    counts = json_lines(spark, path).groupBy(F.element_at(F.split("file", "/"), -1).alias("file")).agg(F.count("*").alias("lines"))
    both = manifest.join(found, "file", "left").join(counts, "file", "left")
    verdict = F.when(F.isnull("actual"), "missing").when(F.col("actual") != F.col("sha256"), "changed").when(F.coalesce("lines", F.lit(0)) != F.col("records"), "record count").otherwise("verified")
    return both.select("file", verdict.alias("verdict"))


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """(file, format, rows): canonical, upstream or legacy rows by their own fields; mixed files show as several rows."""
    v = F.col("value")
    has = lambda k: F.get_json_object(v, f"$.{k}").isNotNull()
    kind = F.when(F.isnotnull("problem"), "invalid").when(has("format_version"), "canonical").when(has("_meta") & has("questions"), "upstream").when(has("prompt") & has("labels"), "legacy").otherwise("unknown")
    rows = json_lines(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("file"), kind.alias("format"))
    return rows.groupBy("file", "format").agg(F.count("*").alias("rows"))


def recast(rows: DataFrame, text_col: str, label_col: str, options: list[str], most: int = 1500, least: int = 10) -> DataFrame:
    """A public labelled text as state, options and target index; long texts are cut, short ones left out."""
    names = F.array(*[F.lit(o) for o in options])
    state = F.trim(F.substring(text_col, 1, most))
    out = rows.withColumns({"state": state, "target_index": (F.array_position(names, F.col(label_col)) - 1).cast("int")})
    return out.filter((F.length("state") >= least) & (F.col("target_index") >= 0))


def rubric_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Families of rubric cases, one row each, in pseudo-groups of three cases."""
    schema = "description string, families array<struct<name string, question struct<type string, instructions string>, cases array<array<string>>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    families = doc.select(F.posexplode("families").alias("f", "family"))
    cases = families.select("f", "family.name", "family.question.type", F.posexplode("family.cases").alias("i", "case"))
    return cases.select("name", "type", "i", F.get("case", F.lit(0)).alias("state"), F.get("case", F.lit(1)).cast("int").alias("label"), F.concat("name", F.lit(":"), F.floor(F.col("i") / 3).cast("string")).alias("group_id"))


OUTPUTS = "example string, answers map<string, struct<type string, noul double, probabilities map<string, double>>>"


def arm_outputs(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """(arm, example, qid, type, noul, probabilities): answers of several arms, one folder an arm (``name`` or ``arm=name``).

    A file is one JSON document (``whole_files``) or has one on each line. The example is the document's
    own field, else the file's name. Malformed files fail the job.
    """
    found = spark.read.schema(OUTPUTS).json(path, multiLine=whole_files, mode="FAILFAST")
    parts = F.split(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "/")
    arm = F.regexp_replace(F.element_at(parts, -2), "^arm=", "")
    stem = F.regexp_replace(F.element_at(parts, -1), "[.]json$", "")
    rows = found.select(arm.alias("arm"), F.coalesce("example", stem).alias("example"), F.explode("answers").alias("qid", "answer"))
    return rows.select("arm", "example", "qid", "answer.*")
