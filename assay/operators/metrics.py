"""Aggregates over predictions (p, t, label, predicted, correct, top1, primitive, source, group_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import prob
from assay.storage import materialize

BINS = 15
#: Fixed thresholds of the risk-coverage curve and of confident errors.
THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
CONFIDENT = (0.9, 0.95)


def ece_bin(confidence: Column, bins: int = BINS, include_zero: bool = False) -> Column:
    """Bin number by literal edges (b/bins, (b+1)/bins]; null for zero unless it is included."""
    edges = [b / bins for b in range(1, bins)]
    out = F.when(confidence <= 0, F.lit(0) if include_zero else F.lit(None).cast("int"))
    for b, edge in enumerate(edges):
        out = out.when(confidence <= edge, b)
    return out.otherwise(bins - 1)


def ece(rows: DataFrame, by: list[str], confidence: Column | str = "top1", bins: int = BINS, include_zero: bool = False) -> DataFrame:
    """(by, ece): bin sums combined on the map side, then at most ``bins`` rows for each group."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    cells = rows.select(*by, ece_bin(c, bins, include_zero).alias("bin"), c.alias("c"), F.col("correct").cast("double").alias("ok"))
    cells = cells.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("ok").alias("ok"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("ok") - F.col("c"))).otherwise(0.0)
    return cells.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def per_row(rows: DataFrame) -> DataFrame:
    """Row metrics that every summary aggregates."""
    return rows.select(
        "*",
        prob.nll_clip(F.col("p"), F.col("label")).alias("nll"),
        prob.nll_add(F.col("p"), F.col("label")).alias("nll_add"),
        prob.brier(F.col("p"), F.col("t")).alias("brier"),
        F.when(F.col("primitive") == "score", F.abs(prob.expected_score(F.col("p")) - F.col("label"))).alias("score_error"),
    )


def summary_columns() -> list[Column]:
    out = [
        F.count("*").alias("n"),
        F.count_distinct("group_id").alias("n_groups"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("nll").alias("nll"),
        F.avg("nll_add").alias("nll_add"),
        F.avg("brier").alias("brier"),
        F.avg("top1").alias("mean_top1"),
        F.when(F.bool_and(F.col("primitive") == "score"), F.avg("score_error")).alias("score_mae"),
    ]
    for t in CONFIDENT:
        name, sure = str(t).replace("0.", ""), F.col("top1") >= t
        n, wrong = F.count_if(sure), F.count_if(sure & ~F.col("correct"))
        out += [n.alias(f"confident_{name}"), wrong.alias(f"errors_{name}"), F.when(n > 0, F.bround(wrong / n, 4)).alias(f"error_rate_{name}")]
    return out


def with_sets(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Each row once for each grouping set, dropped columns as '*': one Expand, so that one aggregate serves all sets."""
    names = sorted({c for s in sets for c in s})
    each = F.explode(F.array(*[F.struct(*[(F.col(n) if n in s else F.lit("*")).alias(n) for n in names]) for s in sets]))
    rest = [c for c in rows.columns if c not in names]
    return rows.select(*rest, each.alias("set")).select(*rest, *[F.col(f"set.{n}").alias(n) for n in names])


def evaluation(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Overall, by source and by primitive: the whole summary with calibration error."""
    held = per_row(rows).select("group_id", "source", "primitive", "correct", "nll", "nll_add", "brier", "top1", "score_error")
    grouped = held.groupingSets([[], [F.col("source")], [F.col("primitive")]], F.col("source"), F.col("primitive")).agg(*summary_columns(), F.grouping("source").alias("no_source"), F.grouping("primitive").alias("no_primitive"))
    named = grouped.withColumn("by_source", F.when(F.col("no_source") == 0, F.col("source")).otherwise("*")).withColumn("by_primitive", F.when(F.col("no_primitive") == 0, F.col("primitive")).otherwise("*"))
    cells = with_sets(held.select("source", "primitive", "correct", "top1"), [[], ["source"], ["primitive"]])
    errors = ece(cells, ["source", "primitive"], bins=bins).withColumnsRenamed({"source": "by_source", "primitive": "by_primitive"})
    return named.drop("source", "primitive", "no_source", "no_primitive").join(errors, ["by_source", "by_primitive"])


def binary_summary(rows: DataFrame, p_yes: str, label: str) -> DataFrame:
    """Summary of P(yes) against 0/1 labels, as the two-class vector [1 - p, p]."""
    p = F.array(1 - F.col(p_yes), F.col(p_yes))
    held = rows.select(p.alias("p"), F.col(label).cast("int").alias("label"))
    held = held.withColumn("t", prob.one_hot(F.col("label"), F.lit(2))).withColumn("top1", F.array_max("p")).withColumn("correct", prob.argmax(F.col("p")) == F.col("label"))
    out = held.agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(prob.nll_add(F.col("p"), F.col("label"))).alias("nll"), F.avg(prob.brier(F.col("p"), F.col("t"))).alias("brier"), F.avg("top1").alias("mean_top1"))
    return out.crossJoin(ece(held.withColumn("one", F.lit(1)), ["one"]).select("ece"))  # one row each


def risk_coverage(rows: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold, primitive): coverage and risk, overall as '*'. All thresholds in one aggregate, then unpivoted."""
    each = with_sets(rows.select("primitive", "top1", "correct"), [[], ["primitive"]])
    sums = [x for i, t in enumerate(thresholds) for x in (F.count_if(F.col("top1") >= t).alias(f"n{i}"), F.count_if((F.col("top1") >= t) & ~F.col("correct")).alias(f"e{i}"))]
    held = each.groupBy("primitive").agg(F.count("*").alias("total"), *sums)
    points = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("covered"), F.col(f"e{i}").alias("errors")) for i, t in enumerate(thresholds)])
    out = held.select("primitive", "total", F.explode(points).alias("x")).select("primitive", "total", "x.*")
    return out.select("threshold", "primitive", "covered", "errors", F.bround(F.col("covered") / F.col("total"), 4).alias("coverage"), F.when(F.col("covered") > 0, F.bround(F.col("errors") / F.col("covered"), 4)).alias("risk"))


def fidelity(pair: DataFrame) -> list[Column]:
    """Aggregates of a paired run against another: agreement and distances."""
    p, q = F.col("p"), F.col("q")
    return [
        F.count("*").alias("n"),
        F.count_if(F.col("predicted") == F.col("predicted_q")).alias("matches"),
        F.avg((F.col("predicted") == F.col("predicted_q")).cast("double")).alias("agreement"),
        F.avg(prob.jensen_shannon(p, q)).alias("mean_js"),
        F.avg(prob.total_variation(p, q)).alias("mean_tv"),
        F.avg(prob.kl_smoothed(p, q)).alias("mean_kl"),
        F.max(prob.drift(p, q)).alias("max_drift"),
        F.avg(F.when(F.col("primitive") == "noul", F.abs(prob.at(p, F.lit(1)) - prob.at(q, F.lit(1))))).alias("noul_mae"),
    ]


#: Arms that are compared at once.
ARMS = 100


def arm_marks(expected: DataFrame, outputs: DataFrame) -> DataFrame:
    """(example, qid, arm, correct) of each expected answer (example, qid, expected array<string>) in each arm of ``outputs``.

    Yes is a probability of one half or more; otherwise the first of the likeliest options, or levels, is
    right if it is among those expected. An answer that an arm lacks, or of a type that isn't known, has a
    null mark: it is not dropped.
    """
    p = F.map_values("probabilities")
    top = F.get(F.map_keys("probabilities"), F.array_position(p, F.array_max(p)).cast("int") - 1)
    said = F.when(F.col("type") == "noul", F.when(F.col("noul") >= 0.5, "true").when(F.col("noul") < 0.5, "false")).when(F.col("type").isin("choice", "score"), top)
    # files are parsed once, and what is joined are answers without their distributions
    answers = materialize(outputs.select("arm", "example", "qid", said.alias("said")), "answers")
    arms = [r["arm"] for r in answers.select("arm").distinct().limit(ARMS + 1).collect()]
    if len(arms) > ARMS:
        raise ValueError(f"more than {ARMS} arms")
    every = expected.select("example", "qid", "expected", F.explode(F.array(*[F.lit(a) for a in arms]).cast("array<string>")).alias("arm"))
    # a join sorts by its first key's first bytes, which tell answers apart and arms don't
    return every.join(answers, ["qid", "example", "arm"], "left").select("example", "qid", "arm", F.array_contains("expected", F.col("said")).alias("correct"))


def arm_table(marks: DataFrame) -> DataFrame:
    """(example, arm, n, n_correct, n_missing) for each example and, as ``Total``, each arm."""
    each = marks.groupBy("example", "arm").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.count_if(F.isnull("correct")).alias("n_missing"))
    # what is copied for the totals are these sums, not the marks
    sets = each.groupingSets([["example", "arm"], ["arm"]], "example", "arm")
    total = F.when(F.grouping("example") == 1, "Total").otherwise(F.col("example"))
    counted = sets.agg(*[F.sum(c).alias(c) for c in ("n", "n_correct", "n_missing")], total.alias("name"))
    return counted.select(F.col("name").alias("example"), "arm", "n", "n_correct", "n_missing")
