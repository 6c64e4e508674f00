"""Request pipelines: admission budgets, deadlines, outcomes and the path from request to response."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import prob, render, text
from assay.operators.calibrate import Scorer, score_views

#: Fixed status codes of the outcomes.
STATUS = {"ok": 200, "malformed": 400, "unknown": 404, "timeout": 408, "no_length": 411, "too_large": 413, "media": 415, "invalid": 422, "failed": 500, "saturated": 503, "expired": 504}


@dataclass(frozen=True)
class Limits:
    questions: int = 64
    options: int = 255
    views: int = 4096

    def __post_init__(self):
        if any(type(v) is not int or v < 1 for v in (self.questions, self.options, self.views)):
            raise ValueError("limits are positive integers")


def admit(rows: DataFrame, limits: Limits, cold: int = 0) -> DataFrame:
    """Requests (n_questions, n_options, has_state) with ``n_views`` and the first reason to reject them, or null.

    A question whose prior isn't known yet is scored on ``cold`` states beside its own: it adds ``cold``
    times its views. ``n_cold`` counts such questions where the rows have it; otherwise all are.
    """
    views = F.col("n_questions") * F.col("n_options")
    unknown = F.least("n_cold", "n_questions") if "n_cold" in rows.columns else F.col("n_questions")
    cost = views + F.lit(cold) * unknown * F.col("n_options")
    reason = (
        F.when(~F.coalesce("has_state", F.lit(False)), "no state")
        .when(F.col("n_questions") > limits.questions, "too many questions")
        .when(F.col("n_options") > limits.options, "too many options")
        .when(cost > limits.views, "too many views")
    )
    return rows.withColumn("n_views", views).withColumn("reject_reason", reason)


def outcomes(rows: DataFrame, arrived: str, done: str, timeout_ms: int) -> DataFrame:
    """(outcome, n): completed, or expired where the result came after the deadline."""
    late = F.unix_micros(F.col(done).cast("timestamp")) > F.unix_micros(F.col(arrived).cast("timestamp")) + timeout_ms * 1000
    return rows.groupBy(F.when(late, "expired").otherwise("completed").alias("outcome")).agg(F.count("*").alias("n"))


def respond(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """A response for each request: its typed answers in the order of its questions.

    Question ids never enter a prompt, and equal prompts are scored once.
    """
    kind = F.when(F.pmod("i", F.lit(3)) == 0, "noul").when(F.pmod("i", F.lit(3)) == 1, "choice").otherwise("score")
    asked = rows.select("event_id", "event_type", F.explode(F.sequence(F.lit(0), F.col("n_questions").cast("int") - 1)).alias("i"), F.col("n_options").cast("int").alias("k")).withColumn("type", kind)
    asked = asked.withColumn("k", F.when(F.col("type") == "noul", 2).otherwise(F.col("k")))
    keys = F.when(F.col("type") == "noul", F.array(F.lit("no"), F.lit("yes"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.concat(F.lit("o"), j.cast("string"))))
    asked = asked.withColumn("keys", keys)
    options = F.transform("keys", lambda n: render.option_json(n, F.lit(None).cast("string")))
    prompt = render.structured(text.json_string(F.col("event_type")), F.col("type"), F.lit('"Which?"'), options)
    asked = asked.withColumn("prompt", prompt)
    distinct = asked.select("prompt", F.col("k").alias("n_labels")).distinct()
    scored = score_views(distinct, scorer).select("prompt", "p")
    answered = asked.join(scored, "prompt").withColumn("answer", prob.typed_answer(F.col("type"), F.col("keys"), F.col("p")))
    held = answered.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("i", F.to_json("answer").alias("answer")))).alias("a"), F.sum(F.length("prompt")).alias("input_chars"))
    return held.select("event_id", F.transform("a", lambda x: x["answer"]).alias("answers"), "input_chars")
