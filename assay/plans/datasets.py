"""Queries of dataset engineering: keys, duplicates, leakage, splits, filters, quotas, samples, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.functions import prob, text
from assay.operators import cells, filters, groups, pairing, registry, resample

from .fixtures import pairs, pairs_sql, predictions, sql, table
from .registry import query

FOLD = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
SPACED = "(?U)\\s+"


def docs(spark, sf_dir):
    """Documents with a normalised text and a leakage key; the provided texts need no Unicode normal form."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    folded = F.trim(F.regexp_replace(F.lower("text"), SPACED, " "))
    return d.withColumn("content", F.concat(F.lit("content:"), F.sha2(folded, 256)))


DOCS = f"d AS (SELECT *, 'content:'||sha256({FOLD}) AS content FROM documents)"


@query(f"WITH {DOCS} SELECT doc_id, content FROM d QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id) = 1")
def content_dedup(spark, sf_dir):
    """The first document of each content key; a minimum, so that copies are combined before the shuffle."""
    return docs(spark, sf_dir).groupBy("content").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content")


@query(f"WITH {DOCS} SELECT doc_id FROM d a WHERE doc_id % 5 <> 0 AND NOT EXISTS (FROM d b WHERE b.doc_id % 5 = 0 AND b.content = a.content)")
def leak_antijoin(spark, sf_dir):
    """Training rows that share no content with the test rows."""
    d = docs(spark, sf_dir)
    edges = pairing.leakage_edges(d.filter("doc_id % 5 <> 0"), "doc_id", "content")
    test = pairing.leakage_edges(d.filter("doc_id % 5 = 0"), "doc_id", "content")
    return pairing.without_overlap(d.filter("doc_id % 5 <> 0").select("doc_id"), edges, test, "doc_id")


@query(f"WITH {DOCS} SELECT content AS key, count(DISTINCT doc_id % 5 = 0) AS splits FROM d GROUP BY 1 HAVING splits > 1")
def crossing_keys(spark, sf_dir):
    """Keys that occur in both splits."""
    d = docs(spark, sf_dir).withColumn("split", (F.col("doc_id") % 5 == 0).cast("string"))
    return pairing.crossing_keys(d.select(F.col("content").alias("key"), "split"))


@query(f"WITH {DOCS} SELECT DISTINCT doc_id FROM d WHERE content IN (SELECT content FROM d WHERE doc_id % 5 = 0) OR 'content:'||sha256(trim(regexp_replace(lower(text[:1500]), '\\s+', ' ', 'g'))) IN (SELECT content FROM d WHERE doc_id % 5 = 0)")
def prefix_overlap(spark, sf_dir):
    """Documents whose content, or whose first 1,500 characters, equal a test document."""
    d = docs(spark, sf_dir)
    short = F.concat(F.lit("content:"), F.sha2(F.trim(F.regexp_replace(F.lower(F.substring("text", 1, 1500)), SPACED, " ")), 256))
    edges = pairing.leakage_edges(d.withColumn("short", short), "doc_id", "content", "short")
    test = d.filter("doc_id % 5 = 0").select(F.col("content").alias("key")).distinct()
    return edges.join(test, "key", "left_semi").select(F.col("id").alias("doc_id")).distinct()


COMPONENT_SQL = f"""WITH RECURSIVE {DOCS}, e AS (SELECT doc_id AS id, content AS key FROM d UNION SELECT doc_id, 'pair:'||(doc_id//2) FROM d),
n AS (SELECT DISTINCT x.id AS a, y.id AS b FROM e x JOIN e y USING (key)),
r AS (SELECT a AS id, a AS reach FROM n UNION SELECT r.id, n.b FROM r JOIN n ON r.reach = n.a),
comp AS (SELECT id, min(reach) AS component FROM r GROUP BY 1)"""


def doc_edges(spark, sf_dir):
    d = docs(spark, sf_dir)
    pair = F.concat(F.lit("pair:"), F.floor(F.col("doc_id") / 2))
    return pairing.leakage_edges(d.withColumn("pair", pair), "doc_id", "content", "pair")


@query(COMPONENT_SQL + " SELECT id, component FROM comp")
def connected_components(spark, sf_dir):
    """Leakage groups over content keys and a second, overlapping key."""
    return groups.groups(doc_edges(spark, sf_dir))


@query(COMPONENT_SQL + """, touched AS (SELECT DISTINCT component FROM comp WHERE id % 5 = 0), free AS (SELECT component, row_number() OVER (ORDER BY sha256('42:'||component), component) AS n FROM (SELECT DISTINCT component FROM comp WHERE component NOT IN (FROM touched))),
size AS (SELECT greatest(1, round_even(count(*)*0.1, 0)) AS cut FROM free)
SELECT id, component, CASE WHEN id % 5 = 0 THEN 'test' WHEN component IN (FROM touched) THEN 'removed' WHEN n <= cut THEN 'development' WHEN n <= 2*cut THEN 'calibration' ELSE 'train' END AS split FROM comp LEFT JOIN free USING (component), size""")
def group_split(spark, sf_dir):
    """Leakage-safe split by groups; test rows are given, training groups that touch them are removed."""
    edges = doc_edges(spark, sf_dir)
    out = groups.split(edges, edges.filter("id % 5 = 0").select("id"))
    groups.assert_disjoint(edges, out)
    return out


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)//3 AS pseudo_group FROM documents")
def pseudo_groups(spark, sf_dir):
    """Contiguous groups of three by position within each source."""
    rows = resample.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], "at")
    return rows.select("doc_id", F.floor(F.col("at") / 3).alias("pseudo_group"))


@query(f"WITH {sql()} SELECT id FROM pred ORDER BY sha256('42:'||id), id LIMIT 100")
def hash_sample(spark, sf_dir):
    return resample.sample_n(predictions(spark, sf_dir).select("id"), "id", 100)


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def source_quota(spark, sf_dir):
    """The first five documents of each source."""
    return resample.quota(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 5)


@query(f"""WITH {sql()}, f AS (SELECT id, source, primitive FROM pred QUALIFY row_number() OVER (PARTITION BY source, primitive, group_id ORDER BY sha256('42:'||id), id) = 1)
SELECT id, source, primitive FROM f QUALIFY row_number() OVER (PARTITION BY source, primitive ORDER BY sha256('42:'||id), id) <= 8""")
def stratified_quota(spark, sf_dir):
    """Eight examples of each source and primitive in seeded order, none of which shares its group with one before it."""
    rows = predictions(spark, sf_dir).select("id", "source", "primitive", F.array(F.concat_ws("/", "source", "primitive", "group_id")).alias("keys"))
    return resample.disjoint_quota(rows, ["source", "primitive"], "id", "keys", 8).select("id", "source", "primitive")


@query("SELECT doc_id, ['Rate it.', 'How good is it?', 'Judge the text.'][((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 3) + 1] AS instructions FROM documents")
def phrasing_rotation(spark, sf_dir):
    """Phrasings cycled by position within the source."""
    phrases = F.array(*[F.lit(p) for p in ("Rate it.", "How good is it?", "Judge the text.")])
    rows = resample.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], "at")
    return rows.select("doc_id", F.element_at(phrases, (F.pmod("at", F.lit(3)) + 1).cast("int")).alias("instructions"))


@query("WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), e AS (SELECT user_id, n, value AS ema FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, 0.95*e.ema + 0.05*o.value FROM e JOIN o ON o.user_id = e.user_id AND o.n = e.n + 1) SELECT user_id, count(*) AS steps, round(arg_max(ema, n), 6) AS ema FROM e GROUP BY 1")
def running_ema(spark, sf_dir):
    """Exponential moving average (.95 / .05) in time order for each user.

    A day's events of a user are weighted within the day, and days then decay by the events after them,
    so that no row or sort holds a user's whole history.
    """
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    day = Window.partitionBy("user_id", "day")
    after = F.row_number().over(day.orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    order = F.struct("ts", "event_id")
    days = events.withColumn("w", F.pow(F.lit(0.95), after)).groupBy("user_id", "day").agg(F.sum(0.05 * F.col("value") * F.col("w")).alias("s"), F.count("*").alias("n"), F.min_by("value", order).alias("first"))
    later = F.sum("n").over(Window.partitionBy("user_id").orderBy(F.desc("day"))) - F.col("n")
    summed = days.withColumn("later", later).groupBy("user_id").agg(F.sum("n").alias("steps"), F.sum(F.col("s") * F.pow(F.lit(0.95), F.col("later"))).alias("s"), F.min_by("first", "day").alias("first"))
    # the first value starts the average with its whole weight
    return summed.select("user_id", "steps", F.round(F.col("s") + F.col("first") * F.pow(F.lit(0.95), F.col("steps")), 6).alias("ema"))


@query("SELECT content, n AS copies FROM (SELECT md5(text) AS content, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_ids(spark, sf_dir):
    """Identities that occur more than once."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("content")).agg(F.count("*").alias("copies")).filter("copies > 1")


@query("""WITH f AS (SELECT user_id, event_id, ts, value < 20 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value < 20 ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, max(n) AS longest_streak FROM (SELECT user_id, island, count(*) AS n FROM f WHERE bad GROUP BY ALL) GROUP BY 1""")
def failure_streaks(spark, sf_dir):
    """Longest run of failing calls (events below 20) for each caller: gaps and islands, by two numberings of the whole table."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") < 20).alias("bad"))
    rows = resample.consecutive(rows.withColumn("o", F.struct("user_id", "ts", "event_id")), "o", "among_all").drop("o")
    rows = resample.consecutive(rows.withColumn("o", F.struct("user_id", "bad", "ts", "event_id")), "o", "among_alike").drop("o")
    island = F.col("among_all") - F.col("among_alike")  # the same for failing calls of a caller with no other between them
    runs = rows.withColumn("island", island).filter("bad").groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest_streak"))


@query(f"WITH {sql()}, s AS (SELECT id, list_sum(list_transform(range(k), lambda i: i*p[i+1])) AS score FROM pred WHERE primitive='score') SELECT id, round(score,6) AS score FROM s ORDER BY round(score,6) DESC, id LIMIT 50")
def rank_by_score(spark, sf_dir):
    """The fifty examples with the largest expected score."""
    rows = predictions(spark, sf_dir).filter("primitive = 'score'").select("id", F.round(prob.expected_score(F.col("p")), 6).alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(50)


@query(f"WITH {DOCS}, a AS (SELECT DISTINCT content FROM d WHERE doc_id % 5 = 0), b AS (SELECT DISTINCT content FROM d WHERE doc_id % 5 <> 0) SELECT 'union' AS op, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'concat', count(*) FROM (FROM a UNION ALL FROM b)")
def key_sets(spark, sf_dir):
    """Union, intersection, difference and concatenation of two key sets."""
    d = docs(spark, sf_dir)
    a, b = (d.filter(f"doc_id % 5 {op} 0").select("content").distinct() for op in ("=", "<>"))
    kinds = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "concat": a.unionByName(b)}
    out = None
    for name, df in kinds.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.union(row)
    return out


@query(f"WITH {sql()}, {sql('43', 1.5, 'other')} SELECT (SELECT count(*) FROM pred WHERE id NOT IN (SELECT id FROM other WHERE source='embeddings')) AS only_first, (SELECT count(*) FROM other WHERE source='embeddings' AND id NOT IN (SELECT id FROM pred)) AS only_second")
def id_set_equality(spark, sf_dir):
    return pairing.same_ids(predictions(spark, sf_dir), predictions(spark, sf_dir, "43", 1.5).filter("source = 'embeddings'"))


@query("SELECT lang, list_sort(list(DISTINCT source)) [1] AS first_source, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1")
def distinct_origins(spark, sf_dir):
    held = table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return held.select("lang", F.get("s", F.lit(0)).alias("first_source"), F.size("s").cast("bigint").alias("n_sources"))


@query(f"WITH {sql()} SELECT id, source FROM pred WHERE source <> 'es' AND NOT (primitive='choice' AND k > 26) AND list_max(p) < 0.99")
def import_filters(spark, sf_dir):
    """Blocked sources, choices too wide for letters, and overconfident targets are left out."""
    rows = filters.drop_sources(predictions(spark, sf_dir), "es")
    return filters.drop_wide(rows, 26).filter(F.array_max("p") < 0.99).select("id", "source")


NAMES = "['spam','none_of_these','cannot_tell','sales','support','billing','other','unclear_case','praise','bug']"


@query(f"""WITH {sql()}, n AS (SELECT id, primitive, top1, CASE WHEN primitive='choice' THEN {NAMES}[predicted+1] END AS name, group_id FROM pred),
d AS (SELECT *, CASE WHEN ('0x'||substr(sha256(group_id),1,2))::BIGINT % 3 <> 0 THEN 'kept' WHEN top1 < 0.7 THEN 'kept' WHEN name IS NOT NULL AND regexp_matches(name, '(?i){text.UNKNOWN_OPTION}') THEN 'exempt_unknown' ELSE 'dropped_overconfident' END AS disposition FROM n)
SELECT disposition, count(*) AS n FROM d GROUP BY 1""")
def overconfidence_filter(spark, sf_dir):
    """Overconfident answers on missing-evidence rows are dropped, unless they say that it can't be known."""
    names = F.array(*[F.lit(n) for n in ("spam", "none_of_these", "cannot_tell", "sales", "support", "billing", "other", "unclear_case", "praise", "bug")])
    rows = predictions(spark, sf_dir)
    missing = F.pmod(F.conv(F.substring(F.sha2("group_id", 256), 1, 2), 16, 10).cast("bigint"), F.lit(3)) == 0
    name = F.when(F.col("primitive") == "choice", F.element_at(names, F.col("predicted") + 1))
    return filters.counted(rows.withColumn("disposition", filters.overconfident(missing, F.col("top1"), name, 0.7)), "disposition")


@query("SELECT doc_id, len(text) >= 40 AND len(trim(text)) >= 10 AS admitted, CASE WHEN len(trim(text)) < 10 THEN 'short' WHEN len(text) > 8000 THEN 'long' END AS reject_reason FROM documents")
def length_admission(spark, sf_dir):
    """Shortest and longest texts are reported with a reason, not silently skipped."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", ((F.length(t) >= 40) & (F.length(F.trim(t)) >= 10)).alias("admitted"), F.when(F.length(F.trim(t)) < 10, "short").when(F.length(t) > 8000, "long").alias("reject_reason"))


@query(f"WITH {sql()} SELECT id, list_sum(t) = 1 AND len(list_filter(t, lambda x: x=1)) = 1 AS one_hot, abs(list_sum(p)-1) <= 1e-5 AND list_min(p) >= 0 AND list_max(p) <= 1 AS valid, len(list_filter(p, lambda x: x=1)) = 1 AS p_one_hot FROM pred")
def vector_checks(spark, sf_dir):
    one_hot = lambda c: F.size(F.filter(c, lambda x: x == 1)) == 1
    return predictions(spark, sf_dir).select("id", one_hot("t").alias("one_hot"), prob.valid_vector(F.col("p")).alias("valid"), one_hot("p").alias("p_one_hot"))


@query("""SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 WHEN o_orderpriority LIKE '3%' THEN 2 END AS target_index, o_orderpriority[1] IN ('1','2','3') AS accepted FROM orders""")
def label_indices(spark, sf_dir):
    """Gold labels to option positions; labels that no option has are null."""
    o = table(spark, sf_dir, "orders")
    options = F.array(*[F.lit(c) for c in "123"])
    at = filters.label_index(F.lit("choice"), F.substring("o_orderpriority", 1, 1), options)
    return o.select("o_orderkey", "o_orderpriority", at.alias("target_index"), at.isNotNull().alias("accepted"))


@query("SELECT c_custkey, regexp_full_match(c_name, '[\\p{L}\\p{N}._:-]{1,64}') AS name_ok, regexp_full_match(c_mktsegment, '[\\p{L}\\p{N}._:-]{1,64}') AS segment_ok FROM customer")
def workload_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.workload_name_ok(F.col("c_name")).alias("name_ok"), text.workload_name_ok(F.col("c_mktsegment")).alias("segment_ok"))


@query(f"WITH {pairs_sql()} SELECT primitive, count(*) FILTER (predicted<>predicted_q) AS argmax_changes, round(max(list_max(list_transform(pq, lambda z: abs(z[1]-z[2])))),6) AS max_abs_diff FROM pair GROUP BY 1")
def refresh_change(spark, sf_dir):
    """What changed between a cached and a fresh run of the same cases."""
    return pairs(spark, sf_dir).groupBy("primitive").agg(F.count_if(F.col("predicted") != F.col("predicted_q")).alias("argmax_changes"), F.round(F.max(prob.drift(F.col("p"), F.col("q"))), 6).alias("max_abs_diff"))


@query("SELECT source AS rubric, count(*) AS n_rows, min(doc_id) AS first_row FROM documents WHERE lang NOT IN ('es') GROUP BY 1")
def rubric_index(spark, sf_dir):
    """Rows of each rubric, categorical ones left out by an anti-join."""
    d = table(spark, sf_dir, "documents")
    blocked = spark.createDataFrame([("es",)], "lang string")
    return d.join(F.broadcast(blocked), "lang", "left_anti").groupBy(F.col("source").alias("rubric")).agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_row"))  # one literal row


@query("SELECT a.x AS concurrency, b.x AS options, c.x AS readout FROM (VALUES (1),(4)) a(x), (VALUES (3),(26)) b(x), (VALUES ('candidate-v1'),('letters-v1')) c(x)")
def sweep_grid(spark, sf_dir):
    """Every combination of a benchmark's settings."""
    axis = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    return spark.range(1).select(axis("concurrency", (1, 4))).select("*", axis("options", (3, 26))).select("*", axis("readout", ("candidate-v1", "letters-v1")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def resume_unseen(spark, sf_dir):
    """Ids that haven't been handled yet (customers without an order)."""
    return pairing.unseen(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def benchmark_containment(spark, sf_dir):
    """Extension: documents that contain a benchmark item verbatim. Items are found by a hashed word window, then compared whole."""
    return filters.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query("""WITH a AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('9:'||doc_id), doc_id) AS n FROM labels)
SELECT doc_id, quality::INT AS quality, CASE WHEN n <= 20 THEN 'fit' ELSE 'eval' END AS part FROM a""")
def fit_eval_parts(spark, sf_dir):
    """A seeded fit set of each class, and the rest for evaluation: a semi and an anti join of the drawn ids."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    drawn = resample.quota(rows, ["quality"], [resample.seeded("9", "doc_id"), F.col("doc_id")], 20)
    return drawn.withColumn("part", F.lit("fit")).unionByName(pairing.unseen(rows, drawn, "doc_id").withColumn("part", F.lit("eval")))


@query(f"""WITH {sql()}, a AS (SELECT id, ('0x'||substr(sha256('patch:'||id),1,2))::BIGINT % 3 AS side, top1 FROM pred WHERE primitive='choice'),
r AS (SELECT CASE WHEN side = 0 AND top1 >= 0.6 THEN 'confident_without_evidence' WHEN side = 1 AND top1 >= 0.6 THEN 'confident_after_removal' ELSE 'kept' END AS reason FROM a) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def patch_filter(spark, sf_dir):
    """Patch examples whose teacher is sure of a substantive answer without the evidence, on either side."""
    side = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit("patch:"), "id"), 256), 1, 2), 16, 10).cast("bigint"), F.lit(3))
    rows = predictions(spark, sf_dir).filter("primitive = 'choice'")
    reason = filters.substantive(side == 0, side == 1, F.col("top1"), F.lit("a plain answer"), 0.6)
    return filters.counted(rows.withColumn("reason", F.coalesce(reason, F.lit("kept"))), "reason")


@query(f"""WITH {sql()}, {DOCS}, g AS (SELECT 'softness' AS gate, avg((top1 < 0.99)::INT) >= 0.10 AS ok FROM pred UNION ALL SELECT 'agreement', avg(correct::INT) BETWEEN 0.60 AND 0.97 FROM pred
 UNION ALL SELECT 'coverage', min(n) >= 10 FROM (SELECT count(*) AS n FROM pred GROUP BY source) UNION ALL SELECT 'leakage', count(*) = 0 FROM d a WHERE doc_id % 5 <> 0 AND EXISTS (FROM d b WHERE b.doc_id % 5 = 0 AND b.content = a.content))
SELECT gate, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g""")
def audit_gates(spark, sf_dir):
    """Gates of a synthetic corpus: softness, agreement, coverage of sources, leakage against the test rows."""
    rows, d = predictions(spark, sf_dir).select("source", "top1", "correct"), docs(spark, sf_dir)
    whole = rows.agg((F.avg((F.col("top1") < 0.99).cast("double")) >= 0.10).alias("softness"), F.avg(F.col("correct").cast("double")).between(0.60, 0.97).alias("agreement"))
    covered = rows.groupBy("source").count().agg((F.min("count") >= 10).alias("ok"))
    test = d.filter("doc_id % 5 = 0").select("content").distinct()
    clean = d.filter("doc_id % 5 <> 0").join(test, "content", "left_semi").agg((F.count("*") == 0).alias("ok"))
    gates = whole.selectExpr("stack(2, 'softness', softness, 'agreement', agreement) as (gate, ok)")
    gates = gates.union(covered.select(F.lit("coverage"), "ok")).union(clean.select(F.lit("leakage"), "ok"))
    return gates.select("gate", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("verdict"))


@query(f"""WITH {sql()}, v AS (SELECT id, k, greatest(k*40, k*25+100) AS tokens, source, primitive FROM pred) SELECT id, primitive FROM v WHERE tokens <= 300 QUALIFY row_number() OVER (PARTITION BY primitive ORDER BY sha256('arch:'||id), id) <= 40""")
def readout_admission(spark, sf_dir):
    """Examples whose prompts fit under both readouts, with a quota for each primitive in seeded order."""
    k = F.col("k")
    rows = predictions(spark, sf_dir).filter(F.greatest(k * 40, k * 25 + 100) <= 300).select("id", "primitive")
    return resample.quota(rows, ["primitive"], [resample.seeded("arch", "id"), F.col("id")], 40)


@query(f"""WITH {sql()} SELECT p.id, f.t AS temperature FROM pred p JOIN (SELECT 'choice' AS primitive, 0.8::DOUBLE AS t UNION ALL SELECT 'noul', 1.5 UNION ALL SELECT 'score', 1.1) f USING (primitive)""")
def one_to_one_join(spark, sf_dir):
    """Predictions joined with their examples exactly once, then with a small dimension of fits."""
    rows = predictions(spark, sf_dir).select("id", "primitive")
    both = pairing.one_to_one(rows, rows.select("id", F.lit(True).alias("seen")), "id")
    fits = spark.createDataFrame([("choice", 0.8), ("noul", 1.5), ("score", 1.1)], "primitive string, temperature double")
    return pairing.with_temperature(both, fits).select("id", "temperature")


#: A plan of cells: values and weights of each axis.
AXES = {
    "domain": {f"d{i:02}": 1 + i % 5 for i in range(22)},
    "length": {"short": 3, "medium": 5, "long": 2},
    "state_format": {"text": 4, "object": 3, "list": 2, "messages": 1},
    "primitive": {"noul": 1, "choice": 1, "score": 1},
    "ambiguity": {"clear": 6, "mixed": 3, "unknown": 1},
}


def _cell_sql() -> str:
    out, read = [], cells.digits([r for values in AXES.values() for r in (len(values), sum(values.values()))])
    digit = lambda d: f"(('0x'||substr(sha256('42:{d[0]}:'||event_id),1,15))::BIGINT // {d[1]} % {d[2]})"
    for i, (name, values) in enumerate(AXES.items()):
        own, alias = cells.alias_table(list(values.values()))
        at, coin = digit(read[2 * i]), digit(read[2 * i + 1])
        out.append(f"{list(values)!r}[CASE WHEN {coin} < {own}[{at} + 1] THEN {at} ELSE {alias}[{at} + 1] END + 1] AS {name}")
    return ", ".join(out)


@query(f"SELECT event_id, {_cell_sql()} FROM events")
def scenario_cells(spark, sf_dir):
    """A cell of the plan for every event's id, in the declared weights."""
    return cells.draw(table(spark, sf_dir, "events").select("event_id"), "event_id", AXES)


@query("""WITH e AS (SELECT event_id, ts, 'w'||(user_id % 40) AS workload, event_id % 29 = 0 AS registers FROM events),
f AS (SELECT workload FROM e WHERE registers GROUP BY 1 ORDER BY min(ts), workload LIMIT 32),
v AS (SELECT workload, ts, max(event_id) AS version FROM e WHERE registers AND workload IN (FROM f) GROUP BY ALL)
SELECT e.event_id, v.version, CASE WHEN v.version IS NULL THEN 'refused' ELSE 'served' END AS outcome FROM (FROM e WHERE NOT registers) e ASOF LEFT JOIN v ON e.workload = v.workload AND e.ts >= v.ts""")
def versions_in_force(spark, sf_dir):
    """Requests beside the calibration of their workload that is in force when they arrive; without one they are refused. One event in 29 registers a version, in a registry of 32 workloads."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("w"), (F.col("user_id") % 40).cast("string")).alias("workload"))
    told = events.filter("event_id % 29 = 0").select("workload", "ts", F.col("event_id").alias("version"))
    out = registry.in_force(events.filter("event_id % 29 <> 0"), registry.admitted(told, 32))
    return out.select("event_id", "version", F.when(F.col("version").isNull(), "refused").otherwise("served").alias("outcome"))


SCENARIOS = """WITH c AS (SELECT doc_id, text, ['choice','score','noul'][doc_id % 3 + 1] AS wanted, ['short','medium','long'][doc_id % 4 % 3 + 1] AS tier FROM documents),
s AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'noul' ELSE wanted END AS kind, CASE wanted WHEN 'choice' THEN 1 + doc_id % 30 WHEN 'score' THEN 1 + doc_id % 11 ELSE 0 END AS k, CASE WHEN doc_id % 13 = 0 THEN '7' ELSE to_json(text)::VARCHAR END AS state,
  CASE wanted WHEN 'choice' THEN doc_id % 32 WHEN 'score' THEN doc_id % 12 ELSE -1 END AS e FROM c)
SELECT doc_id, CASE WHEN kind <> wanted THEN 'primitive mismatch' WHEN kind = 'score' AND k NOT BETWEEN 2 AND 10 THEN 'invalid question' WHEN kind = 'choice' AND e >= k THEN 'expected not among options' WHEN kind = 'choice' AND k NOT BETWEEN 3 AND 26 THEN 'choice option count out of range'
  WHEN kind = 'score' AND e >= k THEN 'expected level out of range' WHEN kind = 'noul' AND doc_id % 5 = 0 THEN 'expected must be a boolean' WHEN state = '7' OR state IS NULL THEN 'state must be a string, object, or array'
  WHEN length(state) > CASE tier WHEN 'short' THEN 500 WHEN 'medium' THEN 2500 ELSE 6500 END THEN 'state too long for its tier' END AS problem FROM s"""


@query(SCENARIOS)
def scenario_problems(spark, sf_dir):
    """Each document as a generated scenario of its cell, and the first thing that is wrong with it."""
    of = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    i = F.col("doc_id")
    wanted = of(("choice", "score", "noul"), i % 3)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", wanted.alias("wanted"), of(("short", "medium", "long"), i % 4 % 3).alias("tier"))
    number = lambda choice, score: F.when(F.col("wanted") == "choice", choice).when(F.col("wanted") == "score", score).otherwise(0)
    names = F.transform(F.sequence(F.lit(0), F.greatest(number(1 + i % 30, 1 + i % 11), F.lit(1)) - 1), lambda j: F.concat(F.lit("o"), j.cast("string")))
    expected = F.when(F.col("wanted") == "choice", F.concat(F.lit("o"), (i % 32).cast("string"))).when(F.col("wanted") == "score", (i % 12).cast("string")).when(i % 5 == 0, "1").otherwise("true")
    state = F.when(i % 13 == 0, "7").otherwise(F.regexp_extract(F.to_json(F.struct("text")), '(?s)^.{8}(.*).$', 1))
    state = F.when(F.isnotnull("text") | (i % 13 == 0), state)
    kind = F.when(i % 11 == 0, "noul").otherwise(F.col("wanted"))
    return rows.select("doc_id", filters.scenario_problem(kind, F.col("wanted"), names, expected, state, F.col("tier")).alias("problem"))
