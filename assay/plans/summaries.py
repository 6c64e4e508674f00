"""Queries of evaluation reports: grouped summaries, calibration error, curves, pairs of runs, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import prob
from assay.operators import metrics, permutations, quantiles, resample

from .fixtures import pairs, pairs_sql, predictions, sql, table
from .registry import query

JS = "0.5*list_sum(list_transform(pq, lambda z: z[1]*ln(z[1]/((z[1]+z[2])/2)) + z[2]*ln(z[2]/((z[1]+z[2])/2))))"
TV = "0.5*list_sum(list_transform(pq, lambda z: abs(z[1]-z[2])))"
KL = "list_sum(list_transform(pq, lambda z: z[1]*ln((z[1]+1e-9)/(z[2]+1e-9))))"
BRIER = "list_sum(list_transform(list_zip(p,t), lambda z: (z[1]-z[2])*(z[1]-z[2])))"
EXPECTED = "list_sum(list_transform(range(k), lambda i: i*p[i+1]))"
ROWS = f"""m AS (SELECT *, -ln(greatest(p[label+1],1e-12)) AS nll, -ln(p[label+1]+1e-12) AS nll_add, {BRIER} AS brier,
 CASE WHEN primitive='score' THEN abs({EXPECTED}-label) END AS score_error FROM pred),
g AS (SELECT *, '*' AS by_source, '*' AS by_primitive FROM m UNION ALL SELECT *, source, '*' FROM m UNION ALL SELECT *, '*', primitive FROM m)"""


def ece_sql(conf: str = "top1", include_zero: bool = False, by: str = "by_source, by_primitive", source: str = "g") -> str:
    zero = "0" if include_zero else "NULL"
    edges = " ".join(f"WHEN {conf} <= {b / 15!r}::DOUBLE THEN {b - 1}" for b in range(1, 15))
    return f"""cells AS (SELECT {by}, CASE WHEN {conf} <= 0 THEN {zero} {edges} ELSE 14 END AS bin, count(*) AS n, sum({conf}) AS c, sum(correct::INT) AS ok FROM {source} GROUP BY ALL),
ece AS (SELECT {by}, sum(CASE WHEN bin IS NULL THEN 0 ELSE abs(ok-c) END)/sum(n) AS ece FROM cells GROUP BY ALL)"""


@query(f"""WITH {sql()}, {ROWS}, {ece_sql()}, agg AS (SELECT by_source, by_primitive, count(*) AS n, count(DISTINCT group_id) AS n_groups, round(avg(correct::INT),6) AS accuracy, round(avg(nll),6) AS nll, round(avg(nll_add),6) AS nll_add, round(avg(brier),6) AS brier, round(avg(top1),6) AS mean_top1,
 round(CASE WHEN bool_and(primitive='score') THEN avg(score_error) END,6) AS score_mae,
 count(*) FILTER (top1>=.9) AS confident_9, count(*) FILTER (top1>=.9 AND NOT correct) AS errors_9, CASE WHEN count(*) FILTER (top1>=.9)>0 THEN round_even(count(*) FILTER (top1>=.9 AND NOT correct)/count(*) FILTER (top1>=.9),4) END AS error_rate_9,
 count(*) FILTER (top1>=.95) AS confident_95, count(*) FILTER (top1>=.95 AND NOT correct) AS errors_95, CASE WHEN count(*) FILTER (top1>=.95)>0 THEN round_even(count(*) FILTER (top1>=.95 AND NOT correct)/count(*) FILTER (top1>=.95),4) END AS error_rate_95 FROM g GROUP BY ALL)
SELECT agg.*, round(ece.ece,6) AS ece FROM agg JOIN ece USING (by_source, by_primitive)""")
def eval_summary(spark, sf_dir):
    """Accuracy, likelihood, Brier, calibration error, level error and confident errors by grouping set."""
    out = metrics.evaluation(predictions(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if c in ("accuracy", "nll", "nll_add", "brier", "mean_top1", "score_mae", "ece") else c for c in out.columns])


@query(f"WITH {sql()}, {ece_sql(by='primitive', source='pred')} SELECT primitive, round(ece,6) AS ece FROM ece")
def ece_15(spark, sf_dir):
    out = metrics.ece(predictions(spark, sf_dir), ["primitive"])
    return out.select("primitive", F.round("ece", 6).alias("ece"))


T2 = "list_transform(p, lambda v: exp(ln(greatest(v, 1e-12))/2))"


@query(f"""WITH {sql()}, s AS (SELECT primitive, correct, list_max({T2})/list_sum({T2}) AS top1 FROM pred), {ece_sql(by='primitive', source='s', include_zero=True)} SELECT primitive, round(ece,6) AS ece FROM ece""")
def top1_ece_t2(spark, sf_dir):
    """Calibration error after temperature 2, confidence zero included in the first bin."""
    rows = predictions(spark, sf_dir).withColumn("top1", F.array_max(prob.temperature_scale(F.col("p"), 2.0)))
    return metrics.ece(rows, ["primitive"], include_zero=True).select("primitive", F.round("ece", 6).alias("ece"))


@query(f"""WITH {sql()}, y AS (SELECT p[2] AS y, label FROM pred WHERE primitive='noul'), b AS (SELECT 1 AS one, y, label, greatest(y,1-y) AS top1, (y > 0.5)::INT = label AS correct FROM y), {ece_sql(by='one', source='b')}
SELECT count(*) AS n, round(avg(correct::INT),6) AS accuracy, round(avg(-ln(CASE label WHEN 1 THEN y ELSE 1-y END + 1e-12)),6) AS nll, round(avg(2*pow(CASE label WHEN 1 THEN 1-y ELSE y END,2)),6) AS brier, round(avg(top1),6) AS mean_top1, (SELECT round(ece,6) FROM ece) AS ece FROM b""")
def binary_summary(spark, sf_dir):
    rows = predictions(spark, sf_dir).filter("primitive = 'noul'").select(prob.at(F.col("p"), F.lit(1)).alias("y"), "label")
    out = metrics.binary_summary(rows, "y", "label")
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query(f"""WITH {sql()}, g AS (SELECT *, '*' AS by_primitive FROM pred UNION ALL SELECT *, primitive FROM pred), t AS (SELECT unnest([0.5,0.6,0.7,0.8,0.9,0.95,0.99]::DOUBLE[]) AS threshold),
 c AS (SELECT threshold, by_primitive AS primitive, count(*) AS total, count(*) FILTER (top1>=threshold) AS covered, count(*) FILTER (top1>=threshold AND NOT correct) AS errors FROM g, t GROUP BY ALL)
SELECT threshold, primitive, covered, errors, round_even(covered/total, 4) AS coverage, CASE WHEN covered>0 THEN round_even(errors/covered, 4) END AS risk FROM c""")
def risk_coverage(spark, sf_dir):
    return metrics.risk_coverage(predictions(spark, sf_dir))


@query(f"""WITH {pairs_sql()} SELECT primitive, count(*) AS n, count(*) FILTER (predicted=predicted_q) AS matches, round(avg((predicted=predicted_q)::INT),6) AS agreement, round(avg({JS}),6) AS mean_js, round(avg({TV}),6) AS mean_tv, round(avg({KL}),6) AS mean_kl,
 round(max(list_max(list_transform(pq, lambda z: abs(z[1]-z[2])))),6) AS max_drift, round(avg(CASE WHEN primitive='noul' THEN abs(p[2]-q[2]) END),6) AS noul_mae FROM pair GROUP BY 1""")
def run_fidelity(spark, sf_dir):
    """Agreement of two runs and the distances between them, by primitive."""
    out = pairs(spark, sf_dir).groupBy("primitive").agg(*metrics.fidelity(pairs(spark, sf_dir)))
    return out.select("primitive", "n", "matches", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith(("agr", "mean", "max", "noul"))])


@query(f"""WITH {pairs_sql()} SELECT count(*) AS n, round(avg(correct::INT),6) AS accuracy_first, round(avg(correct_q::INT),6) AS accuracy_second, round(avg({KL}),6) AS mean_kl, round(avg((predicted=predicted_q)::INT),6) AS agreement FROM pair""")
def teacher_agreement(spark, sf_dir):
    d = lambda c: F.round(F.avg(c.cast("double")), 6)
    return pairs(spark, sf_dir).agg(F.count("*").alias("n"), d(F.col("correct")).alias("accuracy_first"), d(F.col("correct_q")).alias("accuracy_second"), d(prob.kl_smoothed(F.col("p"), F.col("q"))).alias("mean_kl"), d(F.col("predicted") == F.col("predicted_q")).alias("agreement"))


@query(f"""WITH {sql()} SELECT primitive, count(*) AS n, round(avg(correct::INT),6) AS accuracy, count(*) FILTER (p[label+1] < 0.05) AS near_zero_gold, round(avg(-ln(p[label+1]+1e-12)),6) AS nll, round(avg({BRIER}),6) AS brier, round(avg(CASE WHEN primitive='score' THEN abs({EXPECTED}-label) END),6) AS score_mae,
 round(avg((top1>=.8)::INT),6) AS coverage_80, count(*) FILTER (top1>=.8 AND NOT correct) AS errors_80 FROM pred GROUP BY 1""")
def outcome_metrics(spark, sf_dir):
    rows = metrics.per_row(predictions(spark, sf_dir))
    d = lambda c: F.round(F.avg(c if isinstance(c, str) else c.cast("double")), 6)
    return rows.groupBy("primitive").agg(F.count("*").alias("n"), d(F.col("correct")).alias("accuracy"), F.count_if(prob.at(F.col("p"), F.col("label")) < 0.05).alias("near_zero_gold"), d("nll_add").alias("nll"), d("brier").alias("brier"), d("score_error").alias("score_mae"), d(F.col("top1") >= 0.8).alias("coverage_80"), F.count_if((F.col("top1") >= 0.8) & ~F.col("correct")).alias("errors_80"))


DELTA = f"""{pairs_sql()}, delta AS (SELECT group_id, count(*) AS n, sum(correct_q::INT - correct::INT) AS d_acc, sum(-ln(greatest(q[label+1],1e-12)) + ln(greatest(p[label+1],1e-12))) AS d_nll,
 sum(list_sum(list_transform(list_zip(q,t), lambda z: (z[1]-z[2])*(z[1]-z[2]))) - {BRIER}) AS d_brier FROM pair GROUP BY 1)"""


@query(f"WITH {DELTA} SELECT group_id, n, d_acc::BIGINT AS d_acc, round(d_nll,6) AS d_nll, round(d_brier,6) AS d_brier FROM delta")
def paired_deltas(spark, sf_dir):
    out = resample.paired_deltas(pairs(spark, sf_dir))
    return out.select("group_id", "n", "d_acc", F.round("d_nll", 6).alias("d_nll"), F.round("d_brier", 6).alias("d_brier"))


WEIGHT = " ".join(f"WHEN s < '{cut:04x}' THEN {w}" for w, cut in enumerate(resample.poisson_cuts()))


@query(f"""WITH {DELTA}, draw AS (SELECT group_id, b, sha256('42:'||group_id||':'||b) AS h FROM delta, range(125) AS u(b)),
w AS (SELECT group_id, 16*b + j AS r, CASE {WEIGHT} ELSE {len(resample.poisson_cuts())} END AS w FROM (SELECT group_id, b, j, substr(h, 4*j::INT + 1, 4) AS s FROM draw, range(16) AS v(j))),
res AS (SELECT r, sum(w*d_acc)/sum(w*n) AS acc, sum(w*d_nll)/sum(w*n) AS nll, sum(w*d_brier)/sum(w*n) AS brier FROM w JOIN delta USING (group_id) WHERE w > 0 GROUP BY r),
long AS (SELECT 'acc' AS metric, acc::DOUBLE AS v FROM res UNION ALL SELECT 'nll', nll FROM res UNION ALL SELECT 'brier', brier FROM res)
SELECT metric, round(quantile_cont(v, 0.025),6) AS low, round(quantile_cont(v, 0.975),6) AS high, quantile_cont(v, 0.025) > 0 OR quantile_cont(v, 0.975) < 0 AS excludes_zero FROM long GROUP BY 1""")
def paired_bootstrap(spark, sf_dir):
    """95% interval of each paired difference over 2,000 resamples of all groups, and whether it leaves out zero."""
    out = resample.bootstrap(resample.paired_deltas(pairs(spark, sf_dir)), samples=2000)
    return out.select("metric", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "excludes_zero")


@query(f"""WITH {pairs_sql()} SELECT primitive, count(*) AS n, count(*) FILTER (predicted<>predicted_q) AS flips, round(count(*) FILTER (predicted<>predicted_q)/count(*),6) AS flip_rate, round(avg({TV}),6) AS mean_tv, count(*) FILTER (list_max(list_transform(pq, lambda z: abs(z[1]-z[2]))) > 0.5) AS large_changes FROM pair GROUP BY 1""")
def permutation_robustness(spark, sf_dir):
    """Answers that change between two presentations of the same options, over the rows compared."""
    flip = F.col("predicted") != F.col("predicted_q")
    return pairs(spark, sf_dir).groupBy("primitive").agg(F.count("*").alias("n"), F.count_if(flip).alias("flips"), F.round(F.count_if(flip) / F.count("*"), 6).alias("flip_rate"), F.round(F.avg(prob.total_variation(F.col("p"), F.col("q"))), 6).alias("mean_tv"), F.count_if(prob.drift(F.col("p"), F.col("q")) > 0.5).alias("large_changes"))


@query(f"""WITH RECURSIVE {sql()}, o AS (SELECT id, z, r, 1 + ('0x'||substr(sha256('perm:'||id||':'||r),1,12))::BIGINT % (factorial(k::INT)::BIGINT - 1) AS n, range(k) AS rest, []::BIGINT[] AS ord FROM pred, range(4) AS u(r) WHERE primitive = 'choice'
 UNION ALL SELECT id, z, r, n // len(rest), list_filter(rest, lambda x, i: i <> n % len(rest) + 1), list_append(ord, rest[n % len(rest) + 1]) FROM o WHERE len(rest) > 0),
s AS (SELECT r, ord, list_transform(ord, lambda x, i: exp(z[x + 1] - 0.15::DOUBLE*(i - 1))) AS shown, list_transform(z, lambda x, i: exp(x - 0.15::DOUBLE*(i - 1))) AS plain FROM o WHERE len(rest) = 0),
b AS (SELECT r, list_transform(plain, lambda x: x/list_sum(plain)) AS p, list_transform(range(len(ord)), lambda x: shown[list_position(ord, x)]/list_sum(shown)) AS q FROM s),
d AS (SELECT r, list_position(p, list_max(p)) <> list_position(q, list_max(q)) AS flip, list_zip(p, q) AS pq FROM b)
SELECT r::INT AS r, count(*) AS n, count(*) FILTER (flip) AS flips, round(avg(flip::INT),6) AS flip_rate, round(avg({TV}),6) AS mean_tv, count(*) FILTER (list_max(list_transform(pq, lambda z: abs(z[1]-z[2]))) > 0.5) AS large_changes FROM d GROUP BY 1""")
def option_permutations(spark, sf_dir):
    """Every choice asked in four seeded orders of its options, none the order as it stands; a scorer that favours early options answers, and answers are compared in the question's own order."""
    rows = predictions(spark, sf_dir).filter("primitive = 'choice'").select("id", "k", "z", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"))
    rows = rows.withColumn("order", permutations.order_of(permutations.other_code("perm", F.col("k"), "id", "r"), F.col("k")))
    answer = lambda logits: prob.softmax(F.transform(logits, lambda v, place: v - 0.15 * place))
    rows = rows.withColumn("p", answer(F.col("z"))).withColumn("q", permutations.realigned(answer(permutations.presented(F.col("z"), F.col("order"))), F.col("order")))
    out = permutations.sensitivity(rows, "r")
    return out.select("r", "n", "flips", F.round("flip_rate", 6).alias("flip_rate"), F.round("mean_tv", 6).alias("mean_tv"), "large_changes")


@query(f"""WITH {sql()}, g AS (SELECT *, '*' AS by_source, '*' AS by_primitive FROM pred UNION ALL SELECT *, source, '*' FROM pred UNION ALL SELECT *, '*', primitive FROM pred)
SELECT by_source, by_primitive, count(*) AS examples, count(DISTINCT group_id) AS groups, count(DISTINCT source) AS sources FROM g GROUP BY ALL""")
def partition_summary(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("group_id", "source", "primitive", F.col("source").alias("s"))
    each = metrics.with_sets(rows, [[], ["source"], ["primitive"]])
    return each.groupBy(F.col("source").alias("by_source"), F.col("primitive").alias("by_primitive")).agg(F.count("*").alias("examples"), F.count_distinct("group_id").alias("groups"), F.count_distinct("s").alias("sources"))


@query("""WITH u AS (SELECT 'event_type' AS axis, event_type AS value FROM events UNION ALL SELECT 'user_parity', (user_id%2)::VARCHAR FROM events UNION ALL SELECT 'hour', (hour(ts)//6)::VARCHAR FROM events)
SELECT axis, value, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY axis),6) AS share FROM u GROUP BY 1,2""")
def axis_coverage(spark, sf_dir):
    """Tallies of each axis of a plan, from one unpivot and one aggregate."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").selectExpr("stack(3, 'event_type', event_type, 'user_parity', string(user_id % 2), 'hour', string(hour(ts) div 6)) as (axis, value)")
    out = rows.groupBy("axis", "value").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("axis")), 6))  # cells only


@query(f"""WITH {sql()}, g AS (SELECT *, '*' AS s FROM pred UNION ALL SELECT *, source FROM pred) SELECT s AS source, round(avg((top1 < 0.99)::INT),6) AS soft_share, round(avg(correct::INT),6) AS agreement, avg(correct::INT) BETWEEN 0.60 AND 0.97 AS within_gate FROM g GROUP BY 1""")
def softness_audit(spark, sf_dir):
    """Share of soft targets and generator/teacher agreement, overall and by source, against the gate."""
    each = metrics.with_sets(predictions(spark, sf_dir).select("source", "top1", "correct"), [[], ["source"]])
    agree = F.avg(F.col("correct").cast("double"))
    return each.groupBy("source").agg(F.round(F.avg((F.col("top1") < 0.99).cast("double")), 6).alias("soft_share"), F.round(agree, 6).alias("agreement"), agree.between(0.60, 0.97).alias("within_gate"))


@query("SELECT lang, min(len(text)) AS shortest, list_sort(list(len(text)))[count(*)//2 + 1] AS upper_median, max(len(text)) AS longest FROM documents GROUP BY 1")
def length_stats(spark, sf_dir):
    """Shortest, upper median (element n div 2 of the sorted lengths) and longest; exact, from counts of each length."""
    return resample.upper_median(table(spark, sf_dir, "documents").select("lang", F.length("text").alias("length")), "lang", "length")


@query("""WITH v AS (SELECT md5(source||lang) AS rubric, CASE WHEN max(n_chars) > 20000 THEN 'categorical' WHEN max(n_chars) > 12000 THEN 'mixed_unknown_tail' ELSE 'ordinal' END AS verdict, count(*) AS rows FROM documents GROUP BY 1)
SELECT verdict, count(*) AS rubrics, sum(rows)::BIGINT AS rows FROM v GROUP BY 1""")
def verdict_summary(spark, sf_dir):
    """Each distinct rubric is judged once, then rubrics and rows are counted by verdict."""
    docs = table(spark, sf_dir, "documents")
    judged = docs.groupBy(F.md5(F.concat("source", "lang")).alias("rubric")).agg(F.max("n_chars").alias("most"), F.count("*").alias("rows"))
    verdict = F.when(F.col("most") > 20000, "categorical").when(F.col("most") > 12000, "mixed_unknown_tail").otherwise("ordinal")
    return judged.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("rubrics"), F.sum("rows").alias("rows"))


@query(f"""WITH {sql()}, {sql('43', 1.5, 'other')}, a AS (SELECT 'first' AS arm, * FROM pred UNION ALL SELECT 'second', * FROM other), g AS (SELECT arm, source, correct FROM a UNION ALL SELECT arm, 'total', correct FROM a)
SELECT source AS example, count(*) FILTER (arm='first' AND correct) AS first_correct, count(*) FILTER (arm='first') AS first_total, count(*) FILTER (arm='second' AND correct) AS second_correct, count(*) FILTER (arm='second') AS second_total FROM g GROUP BY 1""")
def example_ladder(spark, sf_dir):
    """Correct and total by example and arm, with grand totals: a rollup and a pivot."""
    rows = predictions(spark, sf_dir).withColumn("arm", F.lit("first")).unionByName(predictions(spark, sf_dir, "43", 1.5).withColumn("arm", F.lit("second")))
    rolled = rows.select("source", "arm", F.col("correct").cast("int").alias("ok")).rollup("arm", "source").agg(F.sum("ok").alias("correct"), F.count("*").alias("total")).filter("arm is not null")
    return rolled.groupBy(F.coalesce("source", F.lit("total")).alias("example")).pivot("arm", ["first", "second"]).agg(F.first("correct").alias("correct"), F.first("total").alias("total"))


@query("""SELECT event_type AS route, count(*) AS requests, round(quantile_cont(value, 0.5),6) AS p50, round(quantile_cont(value, 0.95),6) AS p95, round(min(value),6) AS fastest, round(max(value),6) AS slowest, round(sum(value),6) AS total, count(*) FILTER (value > 50) AS over_budget,
 round(count(*)/(date_diff('microsecond', min(ts), max(ts))/1000000.0),6) AS per_second FROM events GROUP BY 1""")
def latency_report(spark, sf_dir):
    """Latency percentiles (interpolated, exact by selection), totals and throughput over a request log; events stand for requests."""
    r = lambda c, n: F.round(c, 6).alias(n)
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    events = table(spark, sf_dir, "events").withColumn("route", F.col("event_type"))
    each = events.groupBy("route").agg(F.count("*").alias("requests"), r(F.min("value"), "fastest"), r(F.max("value"), "slowest"), r(F.sum("value"), "total"), F.count_if(F.col("value") > 50).alias("over_budget"), r(F.count("*") / span, "per_second"))
    found = quantiles.exact_percentiles(events, "route", "value", [0.5, 0.95])
    at = lambda share, n: r(F.max(F.when(F.col("share") == share, F.col("value"))), n)
    return each.join(found.groupBy("route").agg(at(0.5, "p50"), at(0.95, "p95")), "route", "left")


@query(f"""WITH {sql()}, l AS (SELECT primitive, 1.0/k AS w, -ln(p[label+1]) AS loss FROM pred) SELECT primitive, round(sum(w*loss)/sum(w),6) AS weighted_loss FROM l GROUP BY 1""")
def weighted_loss(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("primitive", (1.0 / F.col("k")).alias("w"), prob.cross_entropy(F.col("z"), F.col("t")).alias("loss"))
    return rows.groupBy("primitive").agg(F.round(F.sum(F.col("w") * F.col("loss")) / F.sum("w"), 6).alias("weighted_loss"))


@query(f"""WITH {sql()}, s AS (SELECT source, id, k, r, row_number() OVER (PARTITION BY source, r ORDER BY sha256('7:'||source||':'||r||':'||id), id) AS n, correct FROM pred, range(20) AS u(r)),
r AS (SELECT source, r, avg(correct::INT) AS acc FROM s WHERE n <= 50 GROUP BY 1,2) SELECT source, round(avg(acc),6) AS mean, round(quantile_cont(acc,0.025),6) AS low, round(quantile_cont(acc,0.975),6) AS high FROM r GROUP BY 1""")
def resample_intervals(spark, sf_dir):
    """Mean and interval of accuracy over 20 seeded samples of 50 rows each."""
    rows = predictions(spark, sf_dir).select("source", "id", "correct")
    drawn = resample.sample_k(rows, ["source"], "id", k=50, repeats=20, seed="7")
    acc = drawn.groupBy("source", "r").agg(F.avg(F.col("correct").cast("double")).alias("acc"))
    return acc.groupBy("source").agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.percentile("acc", 0.025), 6).alias("low"), F.round(F.percentile("acc", 0.975), 6).alias("high"))
