"""Queries of answers as vectors, training views, length limits, batches, frozen runs and reserved scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import answers, render, text
from assay.operators import reserved, training

from .fixtures import predictions, sql, table
from .registry import query

DIGIT = "('0x'||substr(sha256(id),1,1))::INT"


def digit():
    return F.conv(F.substring(F.sha2("id", 256), 1, 1), 16, 10).cast("int")


@query(f"""WITH {sql()}, a AS (SELECT id, primitive, p, k, {DIGIT} AS d, list_sum(p) AS total FROM pred),
b AS (SELECT id, CASE WHEN d = 4 THEN 'type mismatch' WHEN primitive <> 'noul' AND d = 0 THEN 'label mismatch' WHEN primitive <> 'noul' AND d = 2 THEN 'not a distribution'
 WHEN primitive = 'choice' AND d = 1 THEN 'choice is not the most likely' WHEN primitive = 'score' AND d = 3 THEN 'score is not expected' END AS problem,
 CASE WHEN primitive <> 'noul' AND d = 0 THEN NULL WHEN primitive <> 'noul' AND d = 2 THEN round(2*p[k], 6) ELSE round(p[k], 6) END AS last FROM a)
SELECT * FROM b""")
def answer_vectors(spark, sf_dir):
    """Answers by option name, in reversed order and some of them spoiled, as vectors in the question's order, with what is wrong."""
    d, rows = digit(), predictions(spark, sf_dir)
    keys = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(F.lit("o"), i.cast("string")))
    rows = rows.withColumn("d", d).withColumn("keys", keys)
    spoiled = F.when(F.col("d") == 2, F.transform("p", lambda v: 2 * v)).otherwise(F.col("p"))
    held = F.map_from_arrays(F.reverse("keys"), F.reverse(spoiled))
    held = F.when(F.col("d") == 0, F.map_filter(held, lambda k, _: k != "o0")).otherwise(held)
    least = F.element_at("keys", F.array_position("p", F.array_min("p")).cast("int"))
    rows = rows.withColumns({
        "held": held, "noul": F.when(F.col("primitive") == "noul", F.get("p", F.lit(1))),
        "choice": F.when(F.col("d") == 1, least).otherwise(F.element_at("keys", F.col("predicted") + 1)),
        "score": F.aggregate("p", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")), lambda a, v: F.struct((a["s"] + v * a["i"]).alias("s"), (a["i"] + 1).alias("i")), lambda a: a["s"]) + F.when(F.col("d") == 3, 0.1).otherwise(0.0),
        "said": F.when(F.col("d") == 4, "none").otherwise(F.col("primitive")),
    })
    c = F.col
    why = answers.problem(c("primitive"), c("said"), c("keys"), c("noul"), c("held"), c("choice"), c("score"))
    vector = answers.ordered(c("primitive"), c("keys"), c("noul"), c("held"))
    return rows.select("id", why.alias("problem"), F.round(F.element_at(vector, -1), 6).alias("last"))


@query(f"""WITH {sql()}, v AS (SELECT id, primitive, k, t, unnest(range(CASE WHEN primitive = 'noul' THEN 1 ELSE k END)) AS view FROM pred)
SELECT id||'/view/'||view AS id, id AS example_id, view::INT AS view, CASE WHEN primitive = 'noul' THEN t[2] ELSE t[view+1] END AS target_yes, round(1/(CASE WHEN primitive = 'noul' THEN 1 ELSE k END), 6) AS weight, false AS ordinal FROM v""")
def training_views(spark, sf_dir):
    """Canonical examples as binary training views, one for each option, which weigh one together."""
    rows = training.views(predictions(spark, sf_dir).select("id", "primitive", F.col("t").alias("target")), training.CANDIDATE)
    return rows.select("id", "example_id", "view", F.get("target", F.lit(1)).alias("target_yes"), F.round("weight", 6).alias("weight"), "ordinal")


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'no prompt or no labels' WHEN doc_id % 6 = 1 THEN 'labels are not distinct' WHEN doc_id % 6 = 2 THEN 'no state in the prompt' WHEN doc_id % 6 = 3 THEN 'not a target' END AS problem FROM documents""")
def legacy_rows(spark, sf_dir):
    """Historical pre-rendered rows, some of them spoiled, with why they can't be trained on."""
    d = F.col("doc_id") % 6
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    prompt = F.concat(F.when(d == 2, "").otherwise("State:\n"), F.coalesce("text", F.lit("")), F.lit("\n\nQuestion: Good?"))
    rows = table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"), F.when(d == 0, F.array().cast("array<string>")).when(d == 1, lits("A", "A")).otherwise(lits("A", "B")).alias("labels"), F.when(d == 3, lits(0.2, 0.2)).otherwise(lits(0.3, 0.7)).alias("target"))
    return rows.select("doc_id", training.legacy_problem(F.col("prompt"), F.col("labels"), F.col("target")).alias("problem"))


@query("SELECT count(*) FILTER (n <= 300) AS kept, count(*) FILTER (n > 300) AS skipped FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS n FROM documents)")
def overlong_rows(spark, sf_dir):
    """Rows within a length, and how many were skipped; labels are checked first. A word stands for a token.

    A text is the state in a prompt and not all of it, so one without a word is kept; a null text has no length and is in neither count.
    """
    texts = table(spark, sf_dir, "documents").filter("text is not null")
    rows = texts.select("doc_id", F.array(F.lit(" A"), F.lit(" B")).alias("labels"), text.n_words(F.col("text")).alias("n"))
    kept, skipped = training.within_length(rows, F.col("n"), 300, least=0)
    return kept.agg(F.count("*").alias("kept")).crossJoin(skipped)  # one row each


@query("""WITH n AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1)//32 AS batch FROM documents), b AS (SELECT batch, max(n_chars) AS padded, row_number() OVER (ORDER BY sha256('42:'||batch), batch) - 1 AS place FROM n GROUP BY 1)
SELECT doc_id, batch, padded, place FROM n JOIN b USING (batch)""")
def length_batches(spark, sf_dir):
    """Batches of 32 rows of nearly equal length, in seeded order."""
    rows = training.batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 32)
    return rows.select("doc_id", "batch", "padded", "place")


@query("SELECT conv_id AS position, 'case-'||conv_id AS id, count(*) AS n_turns FROM conversations GROUP BY 1")
def frozen_run(spark, sf_dir):
    """Cases of a frozen run beside its predictions, by position, of one pinned version."""
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    cases = held.select(F.col("conv_id").alias("position"), F.concat(F.lit("case-"), F.col("conv_id").cast("string")).alias("id"))
    predicted = held.select(F.col("conv_id").alias("position"), F.concat(F.lit("case-"), F.col("conv_id").cast("string")).alias("id"), "n_turns", F.lit("v1").alias("model_version"))
    return training.aligned(cases, predicted, 10_000_000, "v1").select("position", "id", "n_turns")


@query("""WITH p AS (SELECT 'parts' AS source, p_partkey::VARCHAR AS id, trim(trim(p_name)||chr(10)||trim(p_type)) AS state, (p_size - 1)::INT AS label FROM part), d AS (SELECT 'docs', doc_id::VARCHAR, trim(coalesce(text,''), ' '||chr(9)||chr(10)||chr(13)), length(lang)::INT FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('42:'||id), id) - 1 AS place FROM (FROM p UNION ALL FROM d))
SELECT source, id, md5(state[:1500]) AS state_md5, label, place FROM o WHERE length(state) >= 40 OR (source = 'parts' AND length(state) >= 8)""")
def reserved_scan(spark, sf_dir):
    """Two sources with fields of their own (title and content; a text) as states and labels of a reserved test."""
    parts, docs = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    first = training.scanned(parts, "parts", answers.titled(F.col("p_name"), F.col("p_type")), F.col("p_size") - 1, ["p_partkey"], "p_partkey", 8, 1500)
    second = training.scanned(docs, "docs", answers.titled(F.lit(""), F.col("text")), F.length("lang"), ["source"], "doc_id", 40, 1500)
    return first.unionByName(second).select("source", "id", F.md5("state").alias("state_md5"), "label", "place")


@query("SELECT s_suppkey, replace(s_name, 'Supplier#', '') AS name, s_suppkey % 3 < 2 AS paired FROM supplier")
def name_parts(spark, sf_dir):
    """Names without their prefix, and ids that are one side of a pair."""
    rows = table(spark, sf_dir, "supplier")
    side = F.concat(F.col("s_suppkey").cast("string"), F.element_at(F.array(F.lit("-a"), F.lit("-b"), F.lit("-c")), (F.col("s_suppkey") % 3 + 1).cast("int")))
    return rows.select("s_suppkey", answers.without_prefix(F.col("s_name"), "Supplier#").alias("name"), answers.is_paired(side).alias("paired"))


def _legacy_sql() -> str:
    text = lambda s: "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"
    choice, score = text(f"{render.LEGACY_CHOICE}State:\n"), text(f"{render.LEGACY_SCORE}State:\n")
    shown = "array_to_string(list_transform(range(k), lambda i: chr((65 + i)::INT)||'. o'||i), chr(10))"
    return f"""WITH r AS (SELECT doc_id, text, ['choice','score','noul'][doc_id % 3 + 1] AS type, (2 + doc_id % 29)::INT AS k, lang, CASE WHEN doc_id % 3 = 2 THEN ['true','1','"yes"','"no"','0','"true"'][doc_id % 6 + 1] WHEN doc_id % 4 = 0 THEN '"o'||(doc_id % 31)||'"' WHEN doc_id % 4 = 1 THEN '"'||(doc_id % 31)||'"' ELSE (doc_id % 31)::VARCHAR END AS label FROM documents),
i AS (SELECT *, CASE WHEN type = 'noul' THEN (label IN ('true','1','"yes"','"true"'))::INT WHEN type = 'choice' AND doc_id % 4 = 1 OR type = 'score' AND doc_id % 4 = 0 THEN NULL WHEN doc_id % 31 < k THEN doc_id % 31 END AS pos, CASE WHEN type <> 'noul' AND k > 26 THEN 'more options than letters' END AS wide FROM r),
p AS (SELECT *, coalesce(wide, CASE WHEN pos IS NULL THEN 'label names no option' WHEN text IS NULL THEN 'no state or instructions' END) AS problem FROM i)
SELECT doc_id, problem, CASE WHEN problem IS NULL THEN pos::INT END AS target_index, CASE WHEN problem IS NULL THEN CASE WHEN type = 'noul' THEN 2 ELSE k END END::INT AS n_labels, CASE WHEN problem IS NULL THEN 'legacy:'||coalesce(lang, '?') END AS task,
 CASE WHEN problem IS NULL THEN md5(CASE type WHEN 'noul' THEN {choice}||text||{text(chr(10) * 2 + "Question: Fit?" + chr(10) * 2 + "Options:" + chr(10) + "A. no" + chr(10) + "B. yes: it fits" + chr(10) * 2 + "The best option is")}
 WHEN 'choice' THEN {choice}||text||{text(chr(10) * 2 + "Question: Fit?" + chr(10) * 2 + "Options:" + chr(10))}||{shown.replace("'. o'||i", "'. o'||i||CASE i WHEN 1 THEN ': it fits' ELSE '' END")}||{text(chr(10) * 2 + "The best option is")}
 ELSE {score}||text||{text(chr(10) * 2 + "Question: Fit?" + chr(10) * 2 + "Levels:" + chr(10))}||{shown}||{text(chr(10) * 2 + "The best-fitting level is")} END) END AS prompt_md5 FROM p"""


@query(_legacy_sql())
def legacy_conversion(spark, sf_dir):
    """Questions over documents as historical training rows; labels as names, numbers, numbers in quotes and words."""
    i, kind = F.col("doc_id"), F.element_at(F.array(F.lit("choice"), F.lit("score"), F.lit("noul")), (F.col("doc_id") % 3 + 1).cast("int"))
    words = F.element_at(F.array(*[F.lit(x) for x in ("true", "1", '"yes"', '"no"', "0", '"true"')]), (i % 6 + 1).cast("int"))
    number = (i % 31).cast("string")
    label = F.when(i % 3 == 2, words).when(i % 4 == 0, F.concat(F.lit('"o'), number, F.lit('"'))).when(i % 4 == 1, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    names = F.transform(F.sequence(F.lit(0), (1 + i % 29).cast("int")), lambda j: F.concat(F.lit("o"), j.cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("state"), kind.alias("type"), F.lit("Fit?").alias("instructions"), names.alias("names"), F.array(F.lit(None).cast("string"), F.lit("it fits")).alias("descriptions"), label.alias("label"), F.col("lang").alias("src"))
    out = training.legacy_converted(rows)
    return out.select("doc_id", "problem", "target_index", F.when(F.isnotnull("labels"), F.size("labels")).alias("n_labels"), "task", F.md5("prompt").alias("prompt_md5"))


ROLES, SEGMENTS = ["assistant", "system", "user"], ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
#: Each source's shortest state and how many examples it gives.
RESERVED = {"quality": (40, 40), "roles": (20, 30), "parts": (8, 12), "segments": (12, 50)}


def _reserved_sql() -> str:
    content = "'content:'||sha256(to_json(replace(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), 'ß', 'ss'))::VARCHAR)"
    strip = "trim(coalesce(text,''), ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))"
    scans = {
        "quality": f"SELECT doc_id::VARCHAR AS id, {strip} AS state, quality::INT AS label FROM documents JOIN labels USING (doc_id)",
        "roles": f"SELECT conv_id||':'||turn AS id, {strip} AS state, list_position({ROLES}, role) - 1 AS label FROM conversations",
        "parts": "SELECT p_partkey::VARCHAR AS id, trim(trim(p_name)||chr(10)||trim(p_type)) AS state, (p_size - 1)::INT AS label FROM part",
        "segments": f"SELECT c_custkey::VARCHAR AS id, c_name||chr(10)||c_mktsegment AS state, list_position({SEGMENTS}, c_mktsegment) - 1 AS label FROM customer",
    }
    parts, before = [f"ref AS (SELECT {content.format('text')} AS content FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL)"], "SELECT NULL::VARCHAR"
    for name, (least, n) in RESERVED.items():
        parts += [
            f"s_{name} AS (SELECT id, state[:1500] AS state, label, place FROM (SELECT *, row_number() OVER (ORDER BY sha256('42:'||id), id) - 1 AS place FROM ({scans[name]})) WHERE length(state) >= {least})",
            f"c_{name} AS (SELECT *, {content.format('state')} AS content FROM s_{name})",
            f"m_{name} AS (SELECT *, content IN (SELECT content FROM ref) AS leaked, content IN (SELECT content FROM ({before}) AS b(content) WHERE content IS NOT NULL) AS seen FROM c_{name})",
            f"d_{name} AS (SELECT *, NOT leaked AND (seen OR row_number() OVER (PARTITION BY content ORDER BY place) > 1) AS duplicate FROM m_{name})",
            f"k_{name} AS (SELECT * FROM d_{name} WHERE NOT leaked AND NOT duplicate ORDER BY place LIMIT {n})",
        ]
        before += f" UNION ALL SELECT content FROM k_{name}"
    out = []
    for name in RESERVED:
        out += [f"SELECT 'reserved:{name}:'||place AS id, id AS row_id, md5(state) AS state_md5, label::INT AS label, 1 AS n FROM k_{name}"]
        out += [f"SELECT '{name} {why}', NULL, NULL, NULL, count(*) FILTER ({why}) FROM d_{name} WHERE place <= (SELECT max(place) FROM k_{name})" for why in ("leaked", "duplicate")]
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(out)


@query(_reserved_sql())
def reserved_test(spark, sf_dir):
    """Four sources as one reserved test: label orders asserted, quotas in seeded order, leaked and repeated texts passed over and counted."""
    place_of = lambda names, c: (F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c)) - 1).cast("int")
    tables = {
        "quality": (table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id"), "doc_id", F.lit(""), F.col("text"), F.col("quality"), 2),
        "roles": (table(spark, sf_dir, "conversations").withColumn("at", F.concat("conv_id", F.lit(":"), "turn")), "at", F.lit(""), F.col("text"), place_of(ROLES, "role"), len(ROLES)),
        "parts": (table(spark, sf_dir, "part"), "p_partkey", F.col("p_name"), F.col("p_type"), F.col("p_size") - 1, 50),
        "segments": (table(spark, sf_dir, "customer"), "c_custkey", F.col("c_name"), F.col("c_mktsegment"), place_of(SEGMENTS, "c_mktsegment"), len(SEGMENTS)),
    }
    for (rows, *_), name, names in ((tables["roles"], "role", ROLES), (tables["segments"], "c_mktsegment", SEGMENTS)):
        order = rows.select(name).distinct().withColumn("i", F.expr(f"count(*) over (order by {name} rows between unbounded preceding and 1 preceding)"))  # a row for each label
        reserved.check_labels(order, "i", name, names)
    sources = []
    for name, (rows, id_col, title, body, label, width) in tables.items():
        least, n = RESERVED[name]
        sources.append(reserved.Source(name, training.scanned(rows, name, answers.titled(title, body), label, [id_col], id_col, least, 1500), width, n))
    reference = table(spark, sf_dir, "documents").filter("doc_id % 5 = 0 and text is not null").select(text.content_key(text.json_string(F.col("text"))).alias("key"))
    examples, dropped = reserved.reserve(sources, reference)
    none = lambda kind: F.lit(None).cast(kind)
    counts = dropped.select("source", F.expr("stack(2, 'leaked', leaked, 'duplicate', duplicate) as (why, n)"))
    counts = counts.select(F.concat_ws(" ", "source", "why").alias("id"), none("string").alias("row_id"), none("string").alias("state_md5"), none("int").alias("label"), "n")
    return examples.select("id", "row_id", F.md5("state").alias("state_md5"), "label", F.lit(1).cast("long").alias("n")).unionByName(counts)
