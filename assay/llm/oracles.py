"""DuckDB SQL of the corpus queries that SQL can express."""

WORD = "[^\\x20\\x09-\\x0D]"

LINE_DEDUP = f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
h AS (SELECT *, list_transform(lines, lambda l: ('0x'||substr(md5(l),1,7))::BIGINT) AS h FROM d),
e AS (SELECT *, list_filter(range(1, len(lines)+1), lambda i: i = len(lines) OR (h[i] + 31*coalesce(CASE WHEN i > 1 THEN h[i-1] END, 0)) % 4 = 0) AS ends FROM h),
c AS (SELECT doc_id, CASE WHEN j > 1 THEN ends[j-1] ELSE 0 END AS a, ends[j] AS b, array_to_string(lines[CASE WHEN j > 1 THEN ends[j-1] ELSE 0 END + 1 : ends[j]], chr(10)) AS chunk FROM (SELECT *, unnest(range(1, len(ends)+1)) AS j FROM e)),
r AS (SELECT *, b - a >= 2 AND regexp_matches(chunk, '{WORD}') AND row_number() OVER (PARTITION BY chunk, b - a >= 2 ORDER BY doc_id, a) > 1 AS gone FROM c),
l AS (SELECT doc_id, i, lines[i] AS line, len(regexp_extract_all(lines[i], '{WORD}+')) AS n FROM (SELECT *, unnest(range(1, len(lines)+1)) AS i FROM d)),
w AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l WHERE n > 0),
f AS (SELECT w.doc_id, i AS a, nxt AS b, line||chr(10)||lines[nxt] AS chunk FROM w JOIN d ON w.doc_id = d.doc_id WHERE nxt IS NOT NULL UNION ALL SELECT doc_id, i, i, line FROM w WHERE n > 50),
x AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) > 1 AS gone FROM f),
v AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM x WHERE gone),
u AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM v),
k AS (SELECT u.doc_id, u.i, sum(l.n) OVER (PARTITION BY u.doc_id, u.run) AS held FROM u JOIN l ON u.doc_id = l.doc_id AND u.i = l.i),
q AS (SELECT doc_id, i FROM k WHERE held > 50 UNION SELECT doc_id, unnest(range(a + 1, b + 1)) FROM r WHERE gone),
g AS (SELECT l.doc_id, count(q.i) AS n_removed_lines, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (q.i IS NULL), '') AS t FROM l LEFT JOIN q ON l.doc_id = q.doc_id AND l.i = q.i GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks FROM r GROUP BY 1)
SELECT doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed_chunks, 0) AS n_removed_chunks, coalesce(n_removed_lines, 0) AS n_removed_lines, CASE WHEN text IS NOT NULL THEN strlen(t) END AS n_bytes, CASE WHEN text IS NOT NULL THEN md5(t) END AS text_md5 FROM documents LEFT JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)"""

SOURCE_MIX = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '{WORD}+')) AS size, md5('mix:'||coalesce(doc_id::VARCHAR,'')||':'||coalesce(text,'')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, [5,2,1][number % 3 + 1] AS weight, 3*source_size AS cap, (SELECT sum(size) FROM d) AS total FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap/weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(weight) OVER (ORDER BY cap/weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, row_number() OVER (ORDER BY cap/weight, number) AS rn FROM w),
l AS (SELECT coalesce(arg_min((total::DOUBLE - capped::DOUBLE)/free::DOUBLE, rn) FILTER ((total - capped)/free*weight <= cap), 0) AS level FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, level*weight) AS target FROM w, l),
p AS (SELECT *, least(floor(target/greatest(source_size,1)), 3)::BIGINT AS whole FROM t),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target, ((whole + (2*before + size <= 2*(target - whole*source_size))::INT)*size)::BIGINT AS taken
FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source"""

PERSPECTIVES = """WITH t AS (SELECT conv_id, turn, coalesce(role,'unknown') AS name, coalesce(text,'') AS text FROM conversations),
c AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> 'system'),
e AS (SELECT t.*, perspective, CASE WHEN name='system' THEN 'system' WHEN name=perspective THEN 'assistant' ELSE 'user' END AS role FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
h AS (SELECT *, CASE WHEN role='user' THEN '<|user name='||name||'|>'||chr(10) ELSE '<|'||role||'|>'||chr(10) END AS header FROM e),
s AS (SELECT *, header||text||'<|end|>'||chr(10) AS segment FROM h),
o AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s)
SELECT conv_id, turn, perspective, role, name, segment, start, start+length(header) AS mask_start, CASE WHEN role='assistant' THEN start+length(segment) ELSE start+length(header) END AS mask_end, role='assistant' AS trained FROM o"""

HARD_NEGATIVES = """WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

FILTER_AUDIT = f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS words FROM documents),
d AS (SELECT doc_id, part, coalesce(q.good, false) AS good, coalesce(q.toxic, false) AS toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
  100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) q USING (doc_id)),
f AS (SELECT unnest(range(1, 6)) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS places FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT places, list_aggregate(list_transform(places, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, unnest(range(1, 6)) AS step FROM o),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM d GROUP BY ALL),
r AS (SELECT part, filter_order, step, places[step] AS f, n, good, toxic, fails, list_bool_or(list_transform(places[1:step - 1], lambda x: fails[x])) AS gone FROM g, s),
c AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT coalesce(gone, false) AND NOT fails[f]) AS kept, sum(n) FILTER (NOT coalesce(gone, false) AND fails[f]) AS removed,
  sum(n) FILTER (gone AND fails[f]) AS redundant, sum(n) FILTER (fails[f] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
  sum(n) FILTER (NOT coalesce(gone, false) AND fails[f] AND good) AS good_lost, sum(n) FILTER (NOT coalesce(gone, false) AND fails[f] AND toxic) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM c"""
