"""Queries of readers and sinks: tables are written as JSON lines to the shared folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from assay.functions.prob import indices
from assay.operators import metrics
from assay.sources import readers, sinks
from assay.storage import new_path

from .fixtures import predictions, sql, table
from .registry import query


def canonical(spark, sf_dir):
    keys = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(F.lit("o"), i.cast("string")))
    rows = predictions(spark, sf_dir)
    return rows.select("id", "group_id", "source", F.lit('"text"').alias("state"), F.col("primitive").alias("type"), keys.alias("answer_keys"), F.col("t").alias("target"), F.lit("gold").alias("target_origin"), F.lit("{}").alias("provenance"), F.lit(1).alias("format_version"))


@query(f"WITH {sql()} SELECT id, group_id, source, k::INT AS n_options, label::INT AS label FROM pred")
def canonical_round_trip(spark, sf_dir):
    """Examples through the never-overwrite sink and the strict reader."""
    path = new_path(spark, "examples")
    sinks.write_dataset({"train": canonical(spark, sf_dir)}, path)
    rows = readers.read_examples(spark, f"{path}/train/part-*")
    return rows.select("id", "group_id", "source", F.size("answer_keys").alias("n_options"), (F.array_position("target", F.lit(1.0)) - 1).cast("int").alias("label"))


@query("SELECT 'canonical' AS format, (SELECT count(*) FROM labels) AS n_rows UNION ALL SELECT 'legacy', count(*) FROM customer UNION ALL SELECT 'invalid', 2")
def sniffed_formats(spark, sf_dir):
    """Files of several formats told apart by their fields."""
    path = new_path(spark, "mixed")
    canonical(spark, sf_dir).filter("type = 'noul'").write.json(f"{path}/a")
    table(spark, sf_dir, "customer").select(F.col("c_name").alias("prompt"), F.array(F.lit(" A")).alias("labels")).write.json(f"{path}/b")
    spark.createDataFrame([("404: Not Found",), ('{"a":1,"a":2}',)], "value string").coalesce(1).write.text(f"{path}/c")
    return readers.sniffed(spark, f"{path}/*/part-*").groupBy("format").agg(F.sum("rows").alias("n_rows"))


@query("SELECT n_nationkey, n_name, sha256(n_name) AS name_sha FROM nation")
def file_verification(spark, sf_dir):
    """Rows of files that match their manifest by hash and count; a changed file would give none."""
    path = new_path(spark, "verified")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n.coalesce(1).write.json(path)
    manifest = readers.file_hashes(spark, f"{path}/part-*").select("file", "sha256", F.lit(n.count()).alias("records"))
    fine = readers.verify_files(spark, f"{path}/part-*", manifest).filter("verdict = 'verified'")
    rows = readers.read_strict(spark, f"{path}/part-*").withColumn("file", F.element_at(F.split("file", "/"), -1))
    held = rows.join(fine, "file", "left_semi").select(F.from_json("value", "n_nationkey int, n_name string").alias("r")).select("r.*")
    return held.select("n_nationkey", "n_name", F.sha2("n_name", 256).alias("name_sha"))


@query("SELECT count(*) AS held, (SELECT count(*) FROM supplier) AS appended_first, (SELECT count(*) FROM customer) - (SELECT count(*) FROM supplier) AS appended_second FROM customer")
def resumable_append(spark, sf_dir):
    """An append that was cut short and run again holds every id once."""
    path = new_path(spark, "resumed")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    first = sinks.append_unseen(rows.orderBy("id").limit(table(spark, sf_dir, "supplier").count()), path)
    second = sinks.append_unseen(rows, path)
    return spark.read.parquet(path).agg(F.count("*").alias("held")).select("held", F.lit(first).cast("bigint").alias("appended_first"), F.lit(second).cast("bigint").alias("appended_second"))


@query(f"WITH {sql()} SELECT 'case-'||id AS \"case\", id, CASE primitive WHEN 'choice' THEN 10 WHEN 'score' THEN 5 ELSE 2 END::INT AS n_options, label::VARCHAR AS gold_label, predicted::INT AS predicted FROM pred")
def frozen_files(spark, sf_dir):
    """A run frozen as files with its manifest, and read back with every pin checked."""
    path, rows = new_path(spark, "frozen"), predictions(spark, sf_dir)
    kind = F.col("primitive")
    options = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(F.lit("o"), i.cast("string")))
    quoted = F.transform(options, lambda o: F.concat(F.lit('"'), o, F.lit('"')))
    criteria = F.when(kind == "choice", F.concat(F.lit("{"), F.array_join(F.transform(quoted, lambda o: F.concat(o, F.lit(":null"))), ","), F.lit("}"))).when(kind == "score", F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))).otherwise("null")
    question = F.concat(F.lit('{"type":"'), kind, F.lit('","instructions":"Which?","criteria":'), criteria, F.lit("}"))
    state = F.concat(F.lit('{"source":"'), "source", F.lit('","group":"'), "group_id", F.lit('"}'))
    turned = F.concat(F.lit('{"group":"'), "group_id", F.lit('","source":"'), "source", F.lit('"}'))  # the same state, its keys in another order
    case = F.concat(F.lit('{"case":"case-'), "id", F.lit('","example":{"id":"'), "id", F.lit('","state":'), state, F.lit(',"question":'), question, F.lit(',"provenance":{"gold_label":'), F.col("label").cast("string"), F.lit('}},"request":{"state":'), turned, F.lit(',"questions":{"q":'), question, F.lit("}}}"))
    rows.select(case.alias("value")).write.option("maxRecordsPerFile", sinks.FILE_LINES).text(f"{path}/cases.jsonl")
    keys = F.when(kind == "choice", options).when(kind == "score", F.transform(options, lambda _, i: i.cast("string"))).otherwise(F.array(F.lit("no"), F.lit("yes")))
    said = F.struct(F.lit("model-1").alias("model"), F.col("predicted").alias("predicted"))
    rows.select(F.concat(F.lit("case-"), "id").alias("case"), "id", keys.alias("answer_keys"), F.col("label").alias("gold_label"), said.alias("response")).write.json(f"{path}/predictions.jsonl")
    pins = {r["file"]: r["sha256"] for r in readers.file_hashes(spark, f"{path}/cases.jsonl").collect()}
    sinks.write_text(spark, f"{path}/manifest.json", json.dumps({"cases_sha256": pins, "server": {"id": "model-1"}}))
    out = readers.frozen_run(spark, path, 10_000_000)
    return out.select("case", "id", F.size("answer_keys").alias("n_options"), "gold_label", F.get_json_object("response", "$.predicted").cast("int").alias("predicted"))


@query("SELECT doc_id, (list_position(['de','en','es','fr'], lang) - 1)::INT AS target_index, md5(trim(text[:1500])) AS state_md5 FROM documents WHERE len(trim(text[:1500])) >= 10")
def recast_documents(spark, sf_dir):
    """A labelled table recast as a choice; texts cut at 1,500 characters."""
    out = readers.recast(table(spark, sf_dir, "documents"), "text", "lang", ["de", "en", "es", "fr"])
    return out.select("doc_id", "target_index", F.md5("state").alias("state_md5"))


MARKS = f"""WITH {sql()}, {sql('43', 1.5, 'other')}, a AS (SELECT 'first run' AS arm, * FROM pred UNION ALL SELECT 'second+run', * FROM other),
m AS (SELECT arm, group_id AS example, CASE primitive WHEN 'noul' THEN (p[2] >= 0.5) = (label = 1) WHEN 'score' THEN predicted IN (label, label + 1) ELSE predicted = label END AS correct FROM a)
SELECT coalesce(example, 'Total') AS example, arm, count(*) AS n, count(*) FILTER (correct) AS n_correct, 0 AS n_missing FROM m GROUP BY GROUPING SETS ((example, arm), (arm))"""


@query(MARKS)
def example_outputs(spark, sf_dir):
    """Two runs' answers written as JSON by arm, read back and marked against what is expected: a level or the next, an option, yes or no."""
    path = new_path(spark, "outputs")
    kind, label = F.col("primitive"), F.col("label")
    held = F.map_from_arrays(F.transform(indices(F.col("p")), lambda i: i.cast("string")), F.col("p"))
    answer = F.struct(kind.alias("type"), F.when(kind == "noul", F.get("p", F.lit(1))).alias("noul"), F.when(kind != "noul", held).alias("probabilities"))
    for arm, rows in (("first run", predictions(spark, sf_dir)), ("second+run", predictions(spark, sf_dir, "43", 1.5))):
        rows.groupBy(F.col("group_id").alias("example")).agg(F.map_from_entries(F.collect_list(F.struct("id", answer))).alias("answers")).write.json(f"{path}/{arm}")
    right = F.when(kind == "noul", F.array((label == 1).cast("string"))).when(kind == "score", F.array(label.cast("string"), (label + 1).cast("string"))).otherwise(F.array(label.cast("string")))
    expected = predictions(spark, sf_dir).select(F.col("group_id").alias("example"), F.col("id").alias("qid"), right.alias("expected"))
    return metrics.arm_table(metrics.arm_marks(expected, readers.arm_outputs(spark, f"{path}/*/part-*", whole_files=False)))
