"""Predictions derived from the provided tables, in Spark and in the SQL that checks it.

Three sources stand for the three question types: embeddings (choice among ten labels), orders (a
five-level score) and labelled documents (yes or no). The scorer is a test double that reads the gold
label: logit = 4 * hash(seed, id, option) + bump where the option is the label. It exercises the
operators; its accuracy says nothing about any model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import prob


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, group_id, source, primitive, k, label)."""
    e = table(spark, sf_dir, "embeddings").selectExpr("concat('e', vec_id) as id", "concat('e', vec_id div 4) as group_id", "'embeddings' as source", "'choice' as primitive", "10 as k", "int(label) as label")
    o = table(spark, sf_dir, "orders").selectExpr("concat('o', o_orderkey) as id", "concat('c', o_custkey) as group_id", "'orders' as source", "'score' as primitive", "5 as k", "int(substr(o_orderpriority, 1, 1)) - 1 as label")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.selectExpr("concat('d', doc_id) as id", "concat('d', doc_id div 3) as group_id", "lang as source", "'noul' as primitive", "2 as k", "int(quality) as label")
    return reduce(DataFrame.unionByName, (e, o, d))


def scored(rows: DataFrame, seed: str = "42", bump: float = 2.0) -> DataFrame:
    """Predictions: p (probabilities), t (one-hot target), predicted, correct, top1."""
    unit = lambda i: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id"), F.lit(":"), i.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    logits = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: 4 * unit(i) + F.when(i == F.col("label"), bump).otherwise(0.0))
    out = rows.withColumn("z", logits).withColumn("p", prob.softmax(F.col("z"))).withColumn("t", prob.one_hot(F.col("label"), F.col("k")))
    out = out.withColumn("predicted", prob.argmax(F.col("p"))).withColumn("top1", F.array_max("p"))
    return out.withColumn("correct", F.col("predicted") == F.col("label"))


def predictions(spark: SparkSession, sf_dir: str, seed: str = "42", bump: float = 2.0) -> DataFrame:
    return scored(base(spark, sf_dir), seed, bump)


def sql(seed: str = "42", bump: float = 2.0, name: str = "pred") -> str:
    """Common table expressions for DuckDB that give ``name`` the same rows."""
    return f"""base_{name} AS (
  SELECT 'e'||vec_id AS id, 'e'||(vec_id//4) AS group_id, 'embeddings' AS source, 'choice' AS primitive, 10 AS k, label::INT AS label FROM embeddings
  UNION ALL SELECT 'o'||o_orderkey, 'c'||o_custkey, 'orders', 'score', 5, substr(o_orderpriority,1,1)::INT - 1 FROM orders
  UNION ALL SELECT 'd'||doc_id, 'd'||(doc_id//3), lang, 'noul', 2, quality::INT FROM documents JOIN labels USING (doc_id)),
z_{name} AS (SELECT *, list_transform(range(k), lambda i: 4*(('0x'||substr(sha256('{seed}:'||id||':'||i),1,8))::BIGINT)::DOUBLE/4294967296::DOUBLE + CASE WHEN i=label THEN {bump}::DOUBLE ELSE 0::DOUBLE END) AS z FROM base_{name}),
x_{name} AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS x FROM z_{name}),
p_{name} AS (SELECT id, group_id, source, primitive, k, label, z, list_transform(x, lambda v: v/list_sum(x)) AS p, list_transform(range(k), lambda i: CASE WHEN i=label THEN 1::DOUBLE ELSE 0::DOUBLE END) AS t FROM x_{name}),
{name} AS (SELECT *, list_position(p, list_max(p)) - 1 AS predicted, list_max(p) AS top1, list_position(p, list_max(p)) - 1 = label AS correct FROM p_{name})"""


def pairs_sql(how: str = "list_zip(a.p, b.p)") -> str:
    """Two runs of the test double joined by id: columns of ``a``, and q, the second run's vector."""
    return f"{sql()}, {sql('43', 1.5, 'other')}, pair AS (SELECT a.*, b.p AS q, b.predicted AS predicted_q, b.correct AS correct_q, list_zip(a.p, b.p) AS pq FROM pred a JOIN other b USING (id))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.operators.pairing import pair_runs

    return pair_runs(predictions(spark, sf_dir), predictions(spark, sf_dir, "43", 1.5))
