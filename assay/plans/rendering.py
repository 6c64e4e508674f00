"""Queries of prompts, views, keys and JSON. States are documents as JSON strings; questions are literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import render, text
from assay.operators import importing, prefixes, recovery
from assay.operators.resample import seeded

from .fixtures import table
from .registry import query

ASK = "Is this a good document?"
#: The SQL form of a plain string as JSON.
J = "to_json({col})::VARCHAR"


def q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def states(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.withColumn("state", text.json_string(F.col("text")))


STATES = "s AS (SELECT doc_id, text, lang, source, to_json(text)::VARCHAR AS state FROM documents)"


@query(f"""WITH {STATES} SELECT doc_id, md5({q(render.STRUCTURED + 'State JSON:' + chr(10))}||state||{q(chr(10) + chr(10) + 'Question type: noul' + chr(10) + 'Instructions JSON:' + chr(10) + '"' + ASK + '"' + chr(10) + chr(10) + 'Answers JSON:' + chr(10) + 'A. {"name":"no","description":null}' + chr(10) + 'B. {"name":"yes","description":"well written"}' + chr(10) + chr(10) + 'The best answer is')}) AS prompt_md5 FROM s""")
def structured_prompts(spark, sf_dir):
    prompt = render.structured(F.col("state"), F.lit("noul"), text.json_string(F.lit(ASK)), render.noul_options(yes=F.lit("well written")))
    return states(spark, sf_dir).select("doc_id", F.md5(prompt).alias("prompt_md5"))


@query(f"""WITH {STATES} SELECT doc_id, md5({q(render.LEGACY_CHOICE + 'State:' + chr(10))}||text||{q(chr(10) * 2 + 'Question: ' + ASK + chr(10) * 2 + 'Options:' + chr(10) + 'A. no' + chr(10) + 'B. yes: well written' + chr(10) * 2 + 'The best option is')}) AS choice_md5,
 md5({q(render.LEGACY_SCORE + 'State:' + chr(10))}||text||{q(chr(10) * 2 + 'Question: ' + ASK + chr(10) * 2 + 'Levels:' + chr(10) + 'A. poor' + chr(10) + 'B. fair' + chr(10) + 'C. good' + chr(10) * 2 + 'The best-fitting level is')}) AS score_md5 FROM s""")
def legacy_prompts(spark, sf_dir):
    """Historical prompts: yes/no as a choice of no and yes, and levels."""
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    choice = render.legacy_choice(F.col("text"), F.lit(ASK), lits("no", "yes"), F.array(F.lit(None).cast("string"), F.lit("well written")))
    score = render.legacy_score(F.col("text"), F.lit(ASK), lits("poor", "fair", "good"))
    return states(spark, sf_dir).select("doc_id", F.md5(choice).alias("choice_md5"), F.md5(score).alias("score_md5"))


VIEW = f"""'{render.CANDIDATE.replace(chr(10), "'||chr(10)||'")}'||'State JSON:'||chr(10)||state||chr(10)||chr(10)||'Question type: score'||chr(10)||'Instructions JSON:'||chr(10)||'"{ASK}"'||chr(10)||'Candidate JSON:'||chr(10)||to_json(level)::VARCHAR||chr(10)||chr(10)||'{render.ASK_SCORE}'||chr(10)||'A. no'||chr(10)||'B. yes'||chr(10)||chr(10)||'The best answer is'"""


@query(f"""WITH {STATES} SELECT doc_id, (v - 1)::INT AS view, md5({VIEW}) AS prompt_md5 FROM (SELECT *, ['poor','fair','good'][v] AS level FROM s, unnest([1,2,3]) AS u(v))""")
def candidate_views(spark, sf_dir):
    """One binary view for each level, its siblings hidden."""
    levels = F.posexplode(F.array(*[F.lit(x) for x in ("poor", "fair", "good")])).alias("view", "level")
    rows = states(spark, sf_dir).select("doc_id", "state", levels)
    prompt = render.candidate(F.col("state"), F.lit("score"), text.json_string(F.lit(ASK)), F.lit(None).cast("string"), text.json_string(F.col("level")))
    return rows.select("doc_id", "view", F.md5(F.coalesce(prompt, F.lit(""))).alias("prompt_md5"))


@query("SELECT k::INT AS k, CASE WHEN k <= 26 THEN array_to_string(list_transform(range(k), lambda i: ' '||chr(65+i::INT)), '') END AS labels FROM range(1, 31) AS t(k)")
def letter_labels(spark, sf_dir):
    return spark.range(1, 31).select(F.col("id").cast("int").alias("k"), F.array_join(render.labels(F.col("id").cast("int")), "").alias("labels"))


@query(f"""WITH {STATES}, p AS (SELECT doc_id, text, 'State:'||chr(10)||text||chr(10)||chr(10)||'Question: {ASK}' AS prompt FROM s) SELECT doc_id, md5(split_part(substr(prompt, 8), chr(10)||chr(10)||'Question: ', 1)) AS state_md5, '{ASK}' AS instructions FROM p WHERE NOT contains(text, 'Question: ')""")
def recovered_prompts(spark, sf_dir):
    """State and question recovered from a prompt; rows that don't render back to the same prompt would be left out."""
    s = states(spark, sf_dir).filter(~F.contains("text", F.lit("Question: ")))
    prompts = s.select("doc_id", F.concat(F.lit("State:\n"), "text", F.lit(f"\n\nQuestion: {ASK}")).alias("prompt"))
    state = F.substring_index(F.substring("prompt", F.lit(8), F.length("prompt")), "\n\nQuestion: ", 1)
    ask = F.substring_index("prompt", "\n\nQuestion: ", -1)
    back = prompts.withColumns({"state": state, "instructions": ask})
    back = back.filter(F.concat(F.lit("State:\n"), "state", F.lit("\n\nQuestion: "), "instructions") == F.col("prompt"))
    return back.select("doc_id", F.md5("state").alias("state_md5"), "instructions")


#: Fifty phrasings of one question; the last two read alike.
PHRASINGS = [f"Is this a good document, by measure {i}?" for i in range(49)] + ["Is this a good document, by measure 48?"]
HEAD = q(render.LEGACY_CHOICE + "State:" + chr(10))
TAIL = f"{q(chr(10) * 2 + 'Question: ')}||ask||{q(chr(10) * 2 + 'Options:' + chr(10) + 'A. no' + chr(10) + 'B. yes' + chr(10) * 2 + 'The best option is')}"


@query(f"""WITH f AS (SELECT 'p'||i AS phrasing, CASE WHEN i = 49 THEN 'Is this a good document, by measure 48?' ELSE 'Is this a good document, by measure '||i||'?' END AS ask FROM range(50) AS u(i)),
a AS (SELECT doc_id, text, CASE WHEN doc_id % 11 = 0 THEN 'What is it?' ELSE 'Is this a good document, by measure '||(doc_id % 49)||'?' END AS ask, doc_id % 13 = 0 AS bare FROM documents),
p AS (SELECT doc_id, CASE WHEN bare THEN ask ELSE {HEAD}||coalesce(text, '')||{TAIL} END AS prompt FROM a),
s AS (SELECT doc_id, prompt, substr(prompt, instr(prompt, 'State:'||chr(10)) + 7) AS rest, prompt LIKE '%State:'||chr(10)||'%' AND prompt LIKE '%'||chr(10)||chr(10)||'Question:%' AS framed FROM p),
m AS (SELECT doc_id, prompt, framed, CASE WHEN framed THEN left(rest, length(rest) - length(string_split(rest, chr(10)||chr(10)||'Question:')[-1]) - 11) END AS state FROM s),
n AS (SELECT m.doc_id, count(f.phrasing) AS n, min(f.phrasing) AS phrasing FROM m LEFT JOIN f ON framed AND prompt = {HEAD}||state||{TAIL} GROUP BY 1)
SELECT doc_id, CASE WHEN n = 1 THEN md5(state) END AS state_md5, CASE WHEN n = 1 THEN phrasing END AS phrasing, CASE WHEN NOT framed THEN 'no frame' WHEN n = 0 THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' END AS reason FROM m JOIN n USING (doc_id)""")
def recovered_phrasings(spark, sf_dir):
    """State and phrasing of historical prompts, by the only one of fifty phrasings that renders to them; else why not."""
    d = states(spark, sf_dir)
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    blank = F.array(*[F.lit(None).cast("string")] * 2)
    ask = F.when(F.col("doc_id") % 11 == 0, "What is it?").otherwise(F.concat(F.lit("Is this a good document, by measure "), (F.col("doc_id") % 49).cast("string"), F.lit("?")))
    prompt = F.when(F.col("doc_id") % 13 == 0, ask).otherwise(render.legacy_choice(F.coalesce("text", F.lit("")), ask, lits("no", "yes"), blank))
    table_ = spark.createDataFrame([(f"p{i}", "choice", ask) for i, ask in enumerate(PHRASINGS)], "phrasing string, type string, instructions string").withColumns({"names": lits("no", "yes"), "descriptions": blank})
    found = recovery.recover(d.select("doc_id", prompt.alias("prompt"), render.labels(F.lit(2)).alias("labels")), table_)
    return found.select("doc_id", F.md5("state").alias("state_md5"), "phrasing", "reason")


RUBRICS = ["Is this a good document?", "Is this document rude?", "Would a child follow it?"]
RUBRIC_PROMPT = f"{q(render.STRUCTURED + 'State JSON:' + chr(10))}||state||{q(chr(10) * 2 + 'Question type: noul' + chr(10) + 'Instructions JSON:' + chr(10))}||to_json(ask)::VARCHAR||{q(chr(10) * 2 + 'Answers JSON:' + chr(10) + 'A. ' + '{' + chr(34) + 'name' + chr(34) + ':' + chr(34) + 'no' + chr(34) + ',' + chr(34) + 'description' + chr(34) + ':null}' + chr(10) + 'B. ' + '{' + chr(34) + 'name' + chr(34) + ':' + chr(34) + 'yes' + chr(34) + ',' + chr(34) + 'description' + chr(34) + ':null}' + chr(10) * 2 + 'The best answer is')}"


@query(f"""WITH {STATES}, p AS (SELECT DISTINCT {RUBRIC_PROMPT} AS prompt FROM s, unnest({RUBRICS!r}) AS u(ask) WHERE state IS NOT NULL),
l AS (SELECT prompt, lag(prompt) OVER (ORDER BY prompt) AS prev, row_number() OVER (ORDER BY prompt) - 1 AS pl FROM p),
c AS (SELECT prompt, pl, CASE WHEN prev IS NULL THEN 0 ELSE list_position(list_transform(list_zip(string_split(prompt, ''), string_split(prev, '')), lambda z: z[1] IS DISTINCT FROM z[2]), true) - 1 END AS shared FROM l),
r AS (SELECT *, max(CASE WHEN shared < 200 THEN pl END) OVER (ORDER BY pl) AS start FROM c),
g AS (SELECT *, start + ((pl - start)//8)*8 AS grp FROM r),
a AS (SELECT grp, count(*) AS members, CASE WHEN count(*) > 1 THEN least(min(CASE WHEN pl <> grp THEN shared END), min(length(prompt)) - 1) ELSE 0 END AS prefix FROM g GROUP BY 1)
SELECT md5(prompt) AS prompt_md5, shared::BIGINT AS shared, members, prefix::BIGINT AS prefix, CASE WHEN pl <> grp THEN prefix ELSE 0 END::BIGINT AS saved FROM g JOIN a USING (grp)""")
def shared_prefixes(spark, sf_dir):
    """Prompts of every document under three rubrics, grouped by the prefix they share, with the characters that a scorer needn't read again."""
    asked = states(spark, sf_dir).select("state", F.explode(F.array(*[F.lit(r) for r in RUBRICS])).alias("ask"))
    prompts = asked.select(render.structured(F.col("state"), F.lit("noul"), text.json_string(F.col("ask")), render.noul_options()).alias("prompt"))
    rows = prefixes.shared_groups(prompts)
    return rows.select(F.md5("prompt").alias("prompt_md5"), "shared", "members", "prefix", F.when(F.col("at") != F.col("grp"), F.col("prefix")).otherwise(0).alias("saved"))


@query("""WITH o AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY sha256('5:'||doc_id||':'||x), x) - 1 AS place FROM documents, unnest(['a','b','c','d']) AS u(x))
SELECT doc_id, string_agg(x, '' ORDER BY place) AS options, max(CASE WHEN x='b' THEN place END)::INT AS target_index, ('0x'||substr(sha256('drop:'||doc_id),1,4))::BIGINT < 13107 AS dropped FROM o GROUP BY doc_id""")
def shuffled_options(spark, sf_dir):
    """Options in seeded order with the target moved along, and a fifth of the descriptions dropped."""
    options = F.array(*[F.struct(seeded("5", F.col("doc_id"), F.lit(x)).alias("h"), F.lit(x).alias("x")) for x in "abcd"])
    order = F.transform(F.array_sort(options), lambda o: o["x"])
    drop = F.conv(F.substring(F.sha2(F.concat(F.lit("drop:"), F.col("doc_id").cast("string")), 256), 1, 4), 16, 10).cast("bigint") < 13107
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(order, "").alias("options"), (F.array_position(order, F.lit("b")) - 1).cast("int").alias("target_index"), drop.alias("dropped"))


@query("WITH s AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, turn, 'content:'||sha256(to_json(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss'))::VARCHAR) AS content FROM s")
def conversation_keys(spark, sf_dir):
    """Content key of each turn in its one-message wrapper: unwrapped, NFKC, white space, case-folded, hashed."""
    wrapped = F.concat(F.lit('[{"role":"user","content":'), text.json_string(F.col("text")), F.lit("}]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.content_key(wrapped).alias("content"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'duplicate key ''a''' WHEN event_id % 4 = 1 THEN 'NaN is not a number' WHEN event_id % 4 = 2 THEN 'not JSON: JSONDecodeError' END AS problem FROM events")
def strict_json(spark, sf_dir):
    """Reasons to reject JSON: repeated keys, NaN, pages that aren't JSON; the events' own properties are fine."""
    raw = F.when(F.col("event_id") % 4 == 0, '{"a":1,"a":2}').when(F.col("event_id") % 4 == 1, '{"a":NaN}').when(F.col("event_id") % 4 == 2, "404: Not Found").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", text.json_problem(raw).alias("problem"))


@query("SELECT event_id, props AS canonical FROM (SELECT event_id, regexp_replace(props, '\\s*([:,])\\s*', '\\1', 'g') AS props FROM events)")
def canonical_json(spark, sf_dir):
    """The events' properties in compact form, keys in their order."""
    return table(spark, sf_dir, "events").select("event_id", text.canonical_json(F.col("props")).alias("canonical"))


@query(f"""WITH {STATES} SELECT doc_id, 'upstream:'||sha256('['||to_json('repo')||','||to_json(doc_id::VARCHAR)||','||to_json(lang)||',"good"]') AS id, 'upstream:repo:'||(doc_id//3) AS group_id, 'upstream:'||source AS source, quality AS label, quality::DOUBLE AS target_yes FROM s JOIN labels USING (doc_id) WHERE source <> 'src9'""")
def upstream_import(spark, sf_dir):
    """Upstream records (state and labelled questions as JSON) to canonical examples, one row for each question."""
    d = states(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").filter("source <> 'src9'")
    quoted = lambda c: text.json_string(c)
    question = F.concat(F.lit('{"good":{"type":"noul","instructions":"Good?","label":'), F.when(F.col("quality") == 1, "true").otherwise("false"), F.lit(',"src":'), quoted(F.col("source")), F.lit("}}"))
    meta = F.concat(F.lit('{"id":'), quoted(F.col("doc_id").cast("string")), F.lit(',"group_id":'), quoted(F.floor(F.col("doc_id") / 3).cast("string")), F.lit(',"source":'), quoted(F.col("source")), F.lit(',"repo":"repo","revision":"r1","split":"train","variant":'), quoted(F.col("lang")), F.lit("}"))
    raw = d.select("doc_id", F.concat(F.lit('{"state":'), "state", F.lit(',"questions":'), question, F.lit(',"_meta":'), meta, F.lit("}")).alias("line"))
    out = importing.upstream_examples(raw, "line", keep=["doc_id"])
    return out.filter("reject_reason is null").select("doc_id", "id", "group_id", "source", F.col("target_index").alias("label"), F.get("target", F.lit(1)).alias("target_yes"))


@query("""SELECT page_id, CASE WHEN NOT contains(html, '{') THEN '{"a":{"b":"}"}}' END AS found FROM pages""")
def embedded_object(spark, sf_dir):
    """The object that the first brace of a free text opens; a page with a brace of its own has none."""
    raw = F.concat("html", F.lit(' answer: {"a": {"b": "}"}} end'))
    return table(spark, sf_dir, "pages").select("page_id", text.balanced_object(raw).alias("found"))


@query("""SELECT event_id, md5('kind: '||event_type||chr(10)||'user: '||user_id||chr(10)||'new: '||CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END||chr(10)||'none: None'||chr(10)||'tags: ['''||event_type||''', 1, None]') AS flat_md5 FROM events""")
def flattened_states(spark, sf_dir):
    """Legacy text of object states: a ``key: value`` line for each member."""
    state = F.concat(F.lit('{"kind":'), text.json_string(F.col("event_type")), F.lit(',"user":'), F.col("user_id").cast("string"), F.lit(',"new":'), (F.col("user_id") % 2 == 0).cast("string"), F.lit(',"none":null,"tags":['), text.json_string(F.col("event_type")), F.lit(",1,null]}"))
    return table(spark, sf_dir, "events").select("event_id", F.md5(text.flatten_state(state)).alias("flat_md5"))


@query(f"""WITH {STATES} SELECT doc_id, sha256('["structured-v1","letters-v1",'||to_json(source)||']') AS prior_key FROM s""")
def prior_keys(spark, sf_dir):
    """Keys under which a question's content-free prior is kept."""
    return states(spark, sf_dir).select("doc_id", text.prior_key(F.lit("structured-v1"), F.lit("letters-v1"), text.json_string(F.col("source"))).alias("prior_key"))
