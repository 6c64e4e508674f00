"""Queries of the probability algebra (one row for each example, or for each example and option)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import prob

from .fixtures import pairs, pairs_sql, predictions, sql, table
from .registry import query


def by_option(rows: DataFrame, vector: Column, *keep: str) -> DataFrame:
    out = rows.select("id", *keep, F.posexplode(vector).alias("idx", "value"))
    return out.select("id", *keep, "idx", F.round("value", 6).alias("value"))


def option_sql(vector: str, keep: str = "", source: str = "pred", more: str = "") -> str:
    return f"WITH {sql()}{more} SELECT id{keep}, i::INT AS idx, round(v[i+1], 6) AS value FROM (SELECT *, {vector} AS v FROM {source}), unnest(range(len(v))) AS u(i)"


SCALE = "list_transform(p, lambda v: exp(ln(greatest(v, 1e-12))/2))"


@query(option_sql("p", source="pred"))
def restricted_softmax(spark, sf_dir):
    return by_option(predictions(spark, sf_dir), prob.softmax(F.col("z")))


@query(option_sql(f"list_transform({SCALE}, lambda v: v/list_sum({SCALE}))"))
def temperature_scale_t2(spark, sf_dir):
    return by_option(predictions(spark, sf_dir), prob.temperature_scale(F.col("p"), 2.0))


PRIOR = ", prior AS (SELECT source, list(m ORDER BY i) AS prior FROM (SELECT source, i, avg(p[i+1]) AS m FROM pred, unnest(range(k)) AS u(i) GROUP BY 1, 2) GROUP BY 1)"


def content_prior(rows: DataFrame) -> DataFrame:
    """(source, prior): mean vector of each source, combined by option on the map side."""
    cells = rows.select("source", F.posexplode("p").alias("i", "v")).groupBy("source", "i").agg(F.avg("v").alias("m"))
    return cells.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("prior"))


@query(f"WITH {sql()}{PRIOR} SELECT source, i::INT AS idx, round(prior[i+1], 6) AS value FROM prior, unnest(range(len(prior))) AS u(i)")
def content_free_prior(spark, sf_dir):
    out = content_prior(predictions(spark, sf_dir)).select("source", F.posexplode("prior").alias("idx", "value"))
    return out.select("source", "idx", F.round("value", 6).alias("value"))


@query(f"""WITH {sql()}{PRIOR}, adj AS (SELECT id, list_transform(list_zip(p, prior), lambda z: z[1]/greatest(z[2], 1e-9)) AS a FROM pred JOIN prior USING (source))
SELECT id, i::INT AS idx, round(a[i+1]/list_sum(a), 6) AS value FROM adj, unnest(range(len(a))) AS u(i)""")
def contextual_correction(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return by_option(rows.join(F.broadcast(content_prior(rows)), "source"), prob.contextual(F.col("p"), F.col("prior")))  # a row for each source of the fixture


@query(f"""WITH {sql()} SELECT id, round(CASE WHEN k<=1 THEN 1 ELSE greatest(0, (top1-1.0/k)/(1-1.0/k)) END, 6) AS choice,
 round(greatest(0, 1 - list_sum(list_transform(range(k), lambda i: p[i+1]*abs(i-predicted)))/(list_sum(list_transform(range(k), lambda i: abs(i-(k-1)/2)))/k)), 6) AS score,
 round(greatest(0, 1 + list_sum(list_transform(p, lambda v: v*ln(v)))/ln(k)), 6) AS entropy FROM pred""")
def confidence_schemes(spark, sf_dir):
    p = F.col("p")
    return predictions(spark, sf_dir).select("id", F.round(prob.confidence_choice(p), 6).alias("choice"), F.round(prob.confidence_score(p), 6).alias("score"), F.round(prob.confidence_entropy(p), 6).alias("entropy"))


@query(f"""WITH {sql()} SELECT id, predicted::INT AS predicted, correct, round(-ln(greatest(p[label+1], 1e-12)), 6) AS nll, round(-ln(p[label+1] + 1e-12), 6) AS nll_add,
 round(list_sum(list_transform(list_zip(p,t), lambda z: (z[1]-z[2])*(z[1]-z[2]))), 6) AS brier,
 round(list_sum(list_transform(range(k), lambda i: i*p[i+1])), 6) AS expected_score,
 round(list_sum(list_transform(range(k), lambda i: pow(list_sum(p[1:i+1]) - list_sum(t[1:i+1]), 2))), 6) AS rps,
 round(-ln(p[label+1]), 6) AS cross_entropy FROM pred""")
def row_metrics(spark, sf_dir):
    p, t, label = F.col("p"), F.col("t"), F.col("label")
    r = lambda c, n: F.round(c, 6).alias(n)
    return predictions(spark, sf_dir).select("id", "predicted", "correct", r(prob.nll_clip(p, label), "nll"), r(prob.nll_add(p, label), "nll_add"), r(prob.brier(p, t), "brier"), r(prob.expected_score(p), "expected_score"), r(prob.ranked_probability(p, t), "rps"), r(prob.cross_entropy(F.col("z"), t), "cross_entropy"))


@query(f"""WITH {pairs_sql()} SELECT id,
 round(0.5*list_sum(list_transform(pq, lambda z: z[1]*ln(z[1]/((z[1]+z[2])/2)) + z[2]*ln(z[2]/((z[1]+z[2])/2)))), 6) AS js,
 round(0.5*list_sum(list_transform(pq, lambda z: abs(z[1]-z[2]))), 6) AS tv,
 round(list_sum(list_transform(pq, lambda z: z[1]*ln((z[1]+1e-9)/(z[2]+1e-9)))), 6) AS kl,
 round(list_max(list_transform(pq, lambda z: abs(z[1]-z[2]))), 6) AS drift FROM pair""")
def distances(spark, sf_dir):
    p, q = F.col("p"), F.col("q")
    r = lambda c, n: F.round(c, 6).alias(n)
    return pairs(spark, sf_dir).select("id", r(prob.jensen_shannon(p, q), "js"), r(prob.total_variation(p, q), "tv"), r(prob.kl_smoothed(p, q), "kl"), r(prob.drift(p, q), "drift"))


@query(f"""WITH {sql()}, reg AS (SELECT id, 'gold' AS regime, t AS v FROM pred UNION ALL SELECT id, 'soft', p FROM pred
 UNION ALL SELECT id, 'hard', list_transform(range(k), lambda i: CASE WHEN i=predicted THEN 1::DOUBLE ELSE 0::DOUBLE END) FROM pred
 UNION ALL SELECT id, 'mixed', list_transform(list_zip(t,p), lambda z: (z[1]+z[2])/2) FROM pred)
SELECT id, regime, i::INT AS idx, round(v[i+1], 6) AS value FROM reg, unnest(range(len(v))) AS u(i)""")
def target_regimes(spark, sf_dir):
    """Gold, hard (one-hot of the teacher's answer), soft and mixed targets of each example."""
    p, t = F.col("p"), F.col("t")
    kinds = {"gold": t, "hard": prob.one_hot(F.col("predicted"), F.col("k")), "soft": p, "mixed": prob.mixed_target(t, p)}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("regime"), v.alias("v")) for n, v in kinds.items()]))
    rows = predictions(spark, sf_dir).select("id", each.alias("x")).select("id", F.col("x.regime").alias("regime"), F.col("x.v").alias("v"))
    return by_option(rows, F.col("v"), "regime")


@query(option_sql("list_transform(t, lambda v: v*0.99/0.99)"))
def target_normalisation(spark, sf_dir):
    """Targets that sum to .99 are brought to one; the fixture's are one-hot times .99."""
    rows = predictions(spark, sf_dir).withColumn("rounded", F.transform("t", lambda v: v * 0.99))
    return by_option(rows, prob.target_normalised(F.col("rounded"), F.col("k")))


@query(f"""WITH {sql()}, keyed AS (SELECT *, CASE primitive WHEN 'noul' THEN ['no','yes'] WHEN 'score' THEN list_transform(range(k), lambda i: i::VARCHAR) ELSE list_transform(range(k), lambda i: 'option'||i) END AS keys FROM pred)
SELECT id, primitive AS type, CASE WHEN primitive='choice' THEN keys[predicted+1] END AS choice, round(CASE WHEN primitive='score' THEN list_sum(list_transform(range(k), lambda i: i*p[i+1])) END, 6) AS score,
 round(CASE WHEN primitive='noul' THEN p[2] END, 6) AS noul,
 round(CASE primitive WHEN 'choice' THEN greatest(0, (top1-1.0/k)/(1-1.0/k)) WHEN 'score' THEN greatest(0, 1 - list_sum(list_transform(range(k), lambda i: p[i+1]*abs(i-predicted)))/(list_sum(list_transform(range(k), lambda i: abs(i-(k-1)/2)))/k)) END, 6) AS confidence,
 CASE WHEN primitive='score' THEN len(keys) END::INT AS n_legend, CASE WHEN primitive<>'noul' THEN len(p) END::INT AS n_probabilities FROM keyed""")
def typed_answers(spark, sf_dir):
    keys = F.when(F.col("primitive") == "noul", F.array(F.lit("no"), F.lit("yes"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(F.when(F.col("primitive") == "choice", "option").otherwise(""), i.cast("string"))))
    a = predictions(spark, sf_dir).select("id", prob.typed_answer(F.col("primitive"), keys, F.col("p")).alias("a"))
    size = lambda c: F.when(F.isnotnull(c), F.size(c))
    return a.select("id", "a.type", "a.choice", F.round("a.score", 6).alias("score"), F.round("a.noul", 6).alias("noul"), F.round("a.confidence", 6).alias("confidence"), size("a.legend").alias("n_legend"), size("a.probabilities").alias("n_probabilities"))


@query(f"""WITH {sql()}, y AS (SELECT id, k, list_transform(range(k), lambda i: p[i+1] * (CASE WHEN k=2 THEN 0 ELSE 1 END)) AS yes FROM pred WHERE primitive <> 'score')
SELECT id, i::INT AS idx, round(CASE WHEN list_sum(yes) > 0 THEN yes[i+1]/list_sum(yes) ELSE 1.0/k END, 6) AS value FROM y, unnest(range(k)) AS u(i)""")
def combined_views(spark, sf_dir):
    """Candidate views (a binary vector for each option) back to one distribution; no mass gives the uniform one."""
    rows = predictions(spark, sf_dir).filter("primitive <> 'score'")
    views = rows.select("id", F.posexplode(F.transform("p", lambda v: v * F.when(F.col("k") == 2, 0.0).otherwise(1.0))).alias("idx", "yes"))
    held = views.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "yes"))).alias("views"))
    return by_option(held, prob.normalise(F.transform("views", lambda v: v["yes"])))


@query(f"""WITH {sql()} SELECT id, round(1.0/k, 6) AS weight, i::INT AS view, round(1-t[i+1], 6) AS target_no, round(t[i+1], 6) AS target_yes FROM pred, unnest(range(k)) AS u(i) WHERE primitive <> 'noul'""")
def view_targets(spark, sf_dir):
    """A binary training view for each option, its target, and its share of the example's weight."""
    rows = predictions(spark, sf_dir).filter("primitive <> 'noul'").select("id", "k", F.posexplode("t").alias("view", "v"))
    return rows.select("id", F.round(1.0 / F.col("k"), 6).alias("weight"), "view", F.round(1 - F.col("v"), 6).alias("target_no"), F.round("v", 6).alias("target_yes"))


#: Fixed coefficients of the letter-share quality scorer, fitted once on the fold doc_id % 5 <> 0.
INTERCEPT, SLOPE = -16.0, 20.0


@query(f"""WITH s AS (SELECT doc_id, len(regexp_replace(text, '[^A-Za-z ]', '', 'g'))::DOUBLE/greatest(len(text),1) AS share, quality FROM documents JOIN labels USING (doc_id)),
q AS (SELECT *, 1/(1+exp(-({INTERCEPT}+{SLOPE}*share))) AS p FROM s)
SELECT doc_id, quality::INT AS quality, round(p, 6) AS noul, p >= 0.5 AS yes, p > 0.5 AS argmax_yes FROM q""")
def noul_quality(spark, sf_dir):
    """P(good document) from the share of letters and spaces, with both tie rules (>= .5 is yes; first index is no)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length(F.regexp_replace("text", "[^A-Za-z ]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("share"))
    p = 1 / (1 + F.exp(-(F.lit(INTERCEPT) + SLOPE * F.col("share"))))
    out = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("p", p)
    return out.select("doc_id", F.col("quality").cast("int").alias("quality"), F.round("p", 6).alias("noul"), (F.col("p") >= 0.5).alias("yes"), (F.col("p") > 0.5).alias("argmax_yes"))
