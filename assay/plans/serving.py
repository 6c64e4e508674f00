"""Queries of request pipelines and streams. Requests are events: their views, budgets, deadlines and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import render, text
from assay.operators import calibrate, deciding, loading, training
from assay.streaming import requests, windows

from .fixtures import table
from .registry import query

REQ = "r AS (SELECT event_id, ts, user_id, event_type, value, 1 + event_id % 14 AS n_questions, 2 + event_id % 9 AS n_options, event_id % 5 AS shape, event_id % 3 AS n_cold FROM events)"


def request_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value", "1 + event_id % 14 as n_questions", "2 + event_id % 9 as n_options", "event_id % 5 as shape", "event_id % 3 as n_cold")


@query(f"WITH {REQ} SELECT event_id, n_questions*n_options AS n_views, CASE WHEN shape = 0 THEN 'no state' WHEN n_questions > 12 THEN 'too many questions' WHEN n_options > 9 THEN 'too many options' WHEN n_options*(n_questions + 3*least(n_cold, n_questions)) > 100 THEN 'too many views' END AS reject_reason FROM r")
def admission(spark, sf_dir):
    """Budgets are checked before anything is scored; a cold prior adds three states for each view of its question."""
    rows = request_rows(spark, sf_dir).withColumn("has_state", F.col("shape") != 0)
    limits = requests.Limits(questions=12, options=9, views=100)
    out = requests.admit(rows, limits, cold=3)
    return out.select("event_id", "n_views", "reject_reason")


@query(f"WITH {REQ}, d AS (SELECT event_id, ts, ts + to_microseconds((value*1000)::BIGINT) AS done, ts + INTERVAL 30 MILLISECOND AS deadline FROM r) SELECT CASE WHEN done > deadline THEN 'expired' ELSE 'completed' END AS outcome, count(*) AS n FROM d GROUP BY 1")
def deadlines(spark, sf_dir):
    """Jobs that end after their deadline are expired, and their late results are discarded."""
    rows = request_rows(spark, sf_dir).withColumn("done", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1000).cast("bigint")))
    return requests.outcomes(rows, "ts", "done", timeout_ms=30)


@query(f"WITH {REQ} SELECT CASE shape WHEN 0 THEN 422 WHEN 1 THEN 503 ELSE 200 END AS status, count(*) AS n FROM r GROUP BY 1")
def status_counts(spark, sf_dir):
    status = F.when(F.col("shape") == 0, requests.STATUS["invalid"]).when(F.col("shape") == 1, requests.STATUS["saturated"]).otherwise(requests.STATUS["ok"])
    return request_rows(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query()
def respond(spark, sf_dir):
    """Requests to responses: explode questions, render, score distinct prompts once, combine, answer, regroup."""
    return requests.respond(request_rows(spark, sf_dir), calibrate.HashScorer())


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2")
def tumbling_windows(spark, sf_dir):
    """Extension: event-time windows for watching decision drift."""
    out = windows.tumbling(table(spark, sf_dir, "events"), "1 hour")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - i*INTERVAL 30 MINUTE AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events, range(2) AS u(i) GROUP BY 1,2")
def sliding_windows(spark, sf_dir):
    out = windows.tumbling(table(spark, sf_dir, "events"), "1 hour", "30 minutes")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS fresh, event_id FROM events),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "6 hours")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1,2")
def streamed_windows(spark, sf_dir):
    """The hourly windows from a stream with a watermark, run to its end: the same rows as the batch."""
    return windows.run_to_end(spark, f"{sf_dir}/events.parquet")


QUESTIONS = [("q1", "noul", "Good?", None, None), ("q2", "choice", "What is it?", ["news", "fiction", "other"], [None, "made up", None]), ("q3", "score", "How good?", ["0", "1", "2", "3"], ["poor", "fair", "good", "great"])]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def _view_sql() -> str:
    """A row for each view of the candidate readout, with its prompt."""
    head = lambda start, kind, ask: f"{_quoted(start + 'State JSON:' + chr(10))}||state||{_quoted(chr(10) * 2 + 'Question type: ' + kind + chr(10) + 'Instructions JSON:' + chr(10) + chr(34) + ask + chr(34) + chr(10))}"
    out = [f"SELECT id, 'q1' AS qid, 0 AS view, {head(render.STRUCTURED, 'noul', 'Good?')}||{_quoted(chr(10) + 'Answers JSON:' + chr(10) + 'A. ' + '{' + '\"name\":\"no\",\"description\":null}' + chr(10) + 'B. ' + '{' + '\"name\":\"yes\",\"description\":null}' + chr(10) * 2 + 'The best answer is')} AS prompt FROM s"]
    for i, option in enumerate(['{"name":"news","description":null}', '{"name":"fiction","description":"made up"}', '{"name":"other","description":null}']):
        rest = 'All alternatives JSON:\n{"news":null,"fiction":"made up","other":null}\nCandidate JSON:\n' + option + "\n\n" + render.ASK_CHOICE + "\n" + render.NO_YES
        out.append(f"SELECT id, 'q2', {i}, {head(render.CANDIDATE, 'choice', 'What is it?')}||{_quoted(rest)} FROM s")
    for i, level in enumerate(QUESTIONS[2][4]):
        rest = f'Candidate JSON:\n"{level}"\n\n' + render.ASK_SCORE + "\n" + render.NO_YES
        out.append(f"SELECT id, 'q3', {i}, {head(render.CANDIDATE, 'score', 'How good?')}||{_quoted(rest)} FROM s")
    return " UNION ALL ".join(out)


@query(f"""WITH s AS (SELECT doc_id AS id, to_json(text)::VARCHAR AS state FROM documents UNION ALL SELECT -1 - i, ['"N/A"', '""', '"none"'][i + 1] FROM range(3) AS u(i)), v AS ({_view_sql()}),
y AS (SELECT id, qid, view, 1/(1 + exp(4*(('0x'||substr(sha256(prompt||chr(10)||'0'),1,8))::BIGINT - ('0x'||substr(sha256(prompt||chr(10)||'1'),1,8))::BIGINT)::DOUBLE/4294967296::DOUBLE)) AS yes FROM v WHERE prompt IS NOT NULL),
c AS (SELECT id, qid, CASE WHEN qid = 'q1' THEN [1 - list(yes)[1], list(yes)[1]] ELSE list(yes ORDER BY view) END AS x FROM y GROUP BY 1, 2),
r AS (SELECT id, qid, unnest(range(len(x))) AS idx, unnest(list_transform(x, lambda e: e/list_sum(x))) AS p FROM c),
prior AS (SELECT qid, idx, avg(p) AS m FROM r WHERE id < 0 GROUP BY 1, 2),
a AS (SELECT id, qid, idx, p/greatest(m, 1e-9) AS a FROM r JOIN prior USING (qid, idx) WHERE id >= 0)
SELECT id AS doc_id, qid, idx::INT AS idx, round(a/sum(a) OVER (PARTITION BY id, qid), 6) AS value FROM a""")
def candidate_decisions(spark, sf_dir):
    """Three typed questions of every document under the candidate readout, each question's content-free prior divided out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.json_string(F.col("text")).alias("state"))
    asked = spark.createDataFrame(QUESTIONS, "qid string, type string, instructions string, names array<string>, descriptions array<string>")
    out = deciding.decide(docs, asked, calibrate.HashScorer(), "doc_id", readout=deciding.CANDIDATE, contextual=True)
    return out.select(F.col("id").alias("doc_id"), "qid", F.posexplode("p").alias("idx", "value")).select("doc_id", "qid", "idx", F.round("value", 6).alias("value"))


def _letters_sql() -> str:
    """A row for each question under the letter readout, with its prompt."""
    out = []
    for qid, kind, ask, names, told in QUESTIONS:
        names, told = names or ["no", "yes"], told or [None, None]
        quoted = ["null" if d is None else f'"{d}"' for d in told]
        lines = [f'{chr(65 + i)}. {{"name":"{n}","description":{d}}}' for i, (n, d) in enumerate(zip(names, quoted))]
        rest = f'\n\nQuestion type: {kind}\nInstructions JSON:\n"{ask}"\n\nAnswers JSON:\n' + "\n".join(lines) + "\n\nThe best answer is"
        out.append(f"SELECT id, '{qid}' AS qid, 0 AS view, {_quoted(render.STRUCTURED + 'State JSON:' + chr(10))}||state||{_quoted(rest)} AS prompt FROM s")
    return " UNION ALL ".join(out)


@query(f"""WITH s AS (SELECT doc_id AS id, source, lang, text, coalesce(to_json(text)::VARCHAR, 'null') AS state FROM documents), v AS (SELECT *, 'letters-v1' AS readout FROM ({_letters_sql()}) UNION ALL SELECT *, 'candidate-v1' FROM ({_view_sql()})),
k AS (SELECT *, CASE qid WHEN 'q1' THEN 2 WHEN 'q2' THEN 3 ELSE 4 END AS n, readout = 'letters-v1' OR qid = 'q1' AS single FROM v)
SELECT k.id||':'||qid||'/view/'||view AS id, readout, s.source AS task, md5(prompt) AS prompt_md5, CASE WHEN single THEN n ELSE 2 END::INT AS n_labels,
 CASE WHEN single THEN (k.id % n = n - 1)::INT::DOUBLE ELSE (k.id % n = view)::INT::DOUBLE END AS last_target, round(1/(CASE WHEN single THEN 1 ELSE n END), 6) AS weight, qid = 'q3' AND readout = 'letters-v1' AS ordinal,
 'content:'||sha256(coalesce(to_json(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss'))::VARCHAR, 'null')) AS content, 'group:'||lang AS in_group FROM k JOIN s ON k.id = s.id""")
def loaded_rows(spark, sf_dir):
    """Three typed questions of every document loaded as training rows under both readouts: prompts, labels, targets, weights, leakage keys."""
    asked = spark.createDataFrame(QUESTIONS, "qid string, type string, instructions string, names array<string>, descriptions array<string>")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce(text.json_string(F.col("text")), F.lit("null")).alias("state"), F.explode(deciding.as_column(asked)).alias("q"))
    n = F.size("q.keys")
    target = F.transform("q.keys", lambda _, i: F.when(i == F.col("doc_id") % n, 1.0).otherwise(0.0))
    examples = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "q.qid").alias("id"), F.col("lang").alias("group_id"), "source", "state", "q", target.alias("target"))
    rows = reduce(DataFrame.unionByName, [loading.canonical_rows(examples, readout=r) for r in (training.LETTERS, training.CANDIDATE)])
    key = lambda start: F.filter("leakage_keys", lambda k: k.startswith(start))[0]
    return rows.select("id", F.col("readout_version").alias("readout"), "task", F.md5("prompt").alias("prompt_md5"), F.size("labels").alias("n_labels"), F.element_at("target", -1).alias("last_target"), F.round("weight", 6).alias("weight"), "ordinal", key("content:").alias("content"), key("group:").alias("in_group"))
