"""Queries of temperature fits, verdicts and the calibration experiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import prob
from assay.operators import calibrate, metrics, pairing, resample
from assay.storage import materialize

from .fixtures import predictions, sql
from .registry import query

#: SQL of a fit: a grid of log temperatures, then a finer one around its best, three times.
def _round(n: int, centre: str, step: float) -> str:
    return f"""g{n} AS (SELECT primitive, {centre} + (i - 20)*{step!r}::DOUBLE AS lt FROM b{n - 1}, range(41) AS u(i)),
l{n} AS (SELECT g{n}.primitive, lt, avg(least(-(lp[label+1]/exp(lt) - list_max(lp)/exp(lt) - ln(list_sum(list_transform(lp, lambda v: exp((v - list_max(lp))/exp(lt)))))), -ln(1e-12))) AS loss FROM lg JOIN g{n} USING (primitive) GROUP BY ALL),
b{n} AS (SELECT primitive, arg_min(lt, loss) AS best, min(loss) AS loss FROM l{n} GROUP BY 1)"""


FIT = f"""{sql()}, lg AS (SELECT primitive, label, list_transform(p, lambda v: ln(greatest(v, 1e-12))) AS lp FROM pred), b0 AS (SELECT DISTINCT primitive, 0::DOUBLE AS best FROM lg),
{_round(1, '0', 0.1497866)}, {_round(2, 'best', 0.0149)}, {_round(3, 'best', 0.0015)}, {_round(4, 'best', 0.00015)}, {_round(5, 'best', 0.000015)}"""


def sample(spark, sf_dir):
    return materialize(predictions(spark, sf_dir).select("id", "source", "primitive", "label", "p", "top1", "correct"), "predictions")


@query(f"WITH {FIT} SELECT primitive, round(exp(best), 3) AS temperature, (SELECT count(*) FROM lg WHERE lg.primitive=b5.primitive) AS n, round(loss, 6) AS nll_after, false AS at_bound FROM b5")
def temperature_fits(spark, sf_dir):
    """Per-primitive temperature that minimises the likelihood loss."""
    out = calibrate.fit_temperatures(sample(spark, sf_dir))
    return out.select("primitive", F.round("temperature", 3).alias("temperature"), "n", F.round("nll_after", 6).alias("nll_after"), "at_bound")


@query(f"WITH {FIT} SELECT primitive, CASE WHEN abs(best) >= ln(1.25) THEN 'apply' ELSE 'other' END AS verdict FROM b5")
def workload_verdicts(spark, sf_dir):
    rows = sample(spark, sf_dir)
    out = calibrate.with_verdicts(rows, calibrate.fit_temperatures(rows), least=25)
    return out.select("primitive", F.when(F.col("verdict") == "apply", "apply").otherwise("other").alias("verdict"))


@query(f"WITH {sql()}, f AS (SELECT 'choice' AS primitive, 0.8 AS t UNION ALL SELECT 'noul', 1.5), w AS (SELECT 'en' AS workload, 'noul' AS primitive, 2.0 AS t) SELECT id, coalesce(w.t, f.t, 1)::DOUBLE AS temperature, round(list_max(list_transform(p, lambda v: pow(v, 1/coalesce(w.t, f.t, 1)::DOUBLE)))/list_sum(list_transform(p, lambda v: pow(v, 1/coalesce(w.t, f.t, 1)::DOUBLE))),6) AS top1 FROM pred LEFT JOIN f ON f.primitive = pred.primitive LEFT JOIN w ON w.workload = pred.source AND w.primitive = pred.primitive")
def temperature_lookup(spark, sf_dir):
    """The workload's temperature, else the primitive's, else one, applied."""
    fits = spark.createDataFrame([("choice", 0.8), ("noul", 1.5)], "primitive string, temperature double")
    own = spark.createDataFrame([("en", "noul", 2.0)], "workload string, primitive string, temperature double")
    rows = pairing.with_temperature(predictions(spark, sf_dir).withColumn("workload", F.col("source")), fits, own)
    return rows.select("id", "temperature", F.round(F.array_max(prob.temperature_scale(F.col("p"), F.col("temperature"))), 6).alias("top1"))


@query()
def calibration_experiment(spark, sf_dir):
    """Raw, serving, pooled and per-workload temperatures over 50 resampled fit sets of 25, 50 and 100 rows, judged on the rest; mean and interval by arm.

    Serving temperatures are fitted by primitive on another run of the same scorer.
    """
    rows = predictions(spark, sf_dir).select("id", F.col("source").alias("workload"), "primitive", "label", "p")
    serving = materialize(calibrate.fit_temperatures(materialize(predictions(spark, sf_dir, "43").select("primitive", "label", "p"), "other_run")).select("primitive", F.col("temperature").alias("serving")), "serving")
    rows = rows.join(F.broadcast(serving), "primitive")  # one row for each primitive
    size = rows.groupBy("workload").agg(F.count("*").alias("size"))
    rows = materialize(rows.join(size, "workload"), "experiment")
    samples = [resample.sample_k(rows.filter(F.col("size") > k + 20), ["workload"], "id", k=k, repeats=50, seed=str(k)).withColumn("k", F.lit(k)) for k in (25, 50, 100)]
    drawn = materialize(reduce(DataFrame.unionByName, samples), "samples")
    own = calibrate.fit_samples(drawn, ["workload", "k", "r"]).withColumnRenamed("temperature", "own")
    pooled = calibrate.fit_samples(drawn, ["k", "r"]).withColumnRenamed("temperature", "pooled")  # a sample of k rows of each workload
    fits = materialize(own.join(pooled, ["k", "r"]), "fits")
    nll = calibrate.held_out_losses(rows, drawn, fits)
    return nll.groupBy("workload", "arm", "k").agg(F.round(F.avg("nll"), 4).alias("nll"), F.round(F.percentile("nll", 0.025), 4).alias("low"), F.round(F.percentile("nll", 0.975), 4).alias("high"))
