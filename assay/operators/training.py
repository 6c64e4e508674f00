"""Training rows: canonical examples as weighted views, checked legacy prompts, length limits and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import prob, render

from .pairing import checked
from .resample import consecutive, seeded

LETTERS, CANDIDATE = "letters-v1", "candidate-v1"


def views(examples: DataFrame, readout: str = LETTERS) -> DataFrame:
    """(id, example_id, view, target, weight, ordinal) of canonical examples (id, primitive, target).

    Letters make one view of an example, and so do yes/no questions; candidates make one for each option,
    each yes or no, which weigh one together. Ordinal views hold a whole distribution over ordered levels.
    """
    if readout not in (LETTERS, CANDIDATE):
        raise ValueError(f"unknown readout {readout}")
    single = F.lit(readout == LETTERS) | (F.col("primitive") == "noul")
    target = F.col("target")
    each = F.when(single, F.array(target)).otherwise(F.transform(target, lambda t: F.array(1.0 - t, t)))
    rows = examples.select(F.col("id").alias("example_id"), "primitive", F.size(each).alias("n"), F.posexplode(each).alias("view", "target"))
    ordinal = (F.col("primitive") == "score") & F.lit(readout == LETTERS)
    return rows.select(F.concat("example_id", F.lit("/view/"), F.col("view").cast("string")).alias("id"), "example_id", "view", "target", (1.0 / F.col("n")).alias("weight"), ordinal.alias("ordinal"))


def legacy_problem(prompt: Column, labels: Column, target: Column) -> Column:
    """Why a historical pre-rendered row can't be trained on; null if it can."""
    n = F.size(labels)
    return (
        F.when(F.isnull(prompt) | (F.coalesce(n, F.lit(0)) < 1), "no prompt or no labels")
        .when(F.exists(labels, lambda x: x.isNull()) | (F.size(F.array_distinct(labels)) < n), "labels are not distinct")
        .when(~F.contains(prompt, F.lit("State:\n")) | ~F.contains(prompt, F.lit("\n\nQuestion:")), "no state in the prompt")
        .when(F.isnull(prob.target_normalised(target, n)), "not a target")
    )


def one_format(rows: DataFrame, version: str = "format_version") -> DataFrame:
    """``rows``, or a failed job where canonical records (with a version) and legacy ones are mixed."""
    counts = rows.agg(F.count_if(F.isnotnull(version)).alias("canonical"), F.count("*").alias("n")).first()
    if 0 < counts["canonical"] < counts["n"]:
        raise ValueError("canonical and legacy records are mixed")
    return rows


def within_length(rows: DataFrame, n_tokens: Column, longest: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): rows of ``least`` to ``longest`` tokens, and one row with the count of longer ones.

    Labels are checked before, so that a bad label in a long row still fails; a row of fewer than ``least``
    tokens does too, and so does one without a count.
    """
    fine = F.coalesce(F.size(F.array_distinct("labels")) == F.size("labels"), F.lit(False))
    length = checked(fine & (n_tokens >= least), "labels are not distinct, or the prompt is empty", n_tokens)
    held = rows.withColumn("n_tokens", length)
    return held.filter(F.col("n_tokens") <= longest), held.agg(F.count_if(F.col("n_tokens") > longest).alias("skipped"))


def batches(rows: DataFrame, id_col: str, n_tokens: str, size: int, seed: str = "42") -> DataFrame:
    """``rows`` with ``batch``, ``place`` (the batch's turn in seeded order) and ``padded``, its longest row.

    Rows are numbered by length, then id, over range partitions; batches are short runs of that order, so
    that rows of a batch need little padding. Turns are numbers by hash, not by position.
    """
    ordered = rows.withColumn("_order", F.struct(n_tokens, id_col))
    numbered = consecutive(ordered, "_order", "_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_order", "_n")
    longest = numbered.groupBy("batch").agg(F.max(n_tokens).alias("padded"))
    turns = consecutive(longest.withColumn("_turn", F.struct(seeded(seed, "batch").alias("h"), "batch")), "_turn", "place").drop("_turn")
    return numbered.join(turns, "batch")


def aligned(cases: DataFrame, predictions: DataFrame, most: int, version: str | None = None) -> DataFrame:
    """A frozen run's cases beside its predictions, by position; fails where the run isn't whole.

    Both tables have (position, id). There are 1 to ``most`` cases, as many predictions, and each position
    holds the same id on both sides; where ``version`` is given, every prediction is of that model version.
    """
    if most < 1:
        raise ValueError("the number of requests must be positive")
    n, m = cases.limit(most + 1).count(), predictions.limit(most + 1).count()
    if not 1 <= n <= most or n != m:
        raise ValueError(f"{n} cases and {m} predictions, of 1 to {most}")
    both = cases.join(predictions.withColumnRenamed("id", "predicted_id"), "position", "full")
    same = F.col("id") == F.col("predicted_id")
    if version is not None:
        same &= F.col("model_version") == F.lit(version)
    return both.withColumn("id", checked(F.coalesce(same, F.lit(False)), "cases and predictions do not match", F.col("id"))).drop("predicted_id")


def scanned(rows: DataFrame, source: str, text: Column, label: Column, extra: list[str], id_col: str, least: int, most: int, seed: str = "42") -> DataFrame:
    """One source of a reserved test: (source, id, state, label, place, extra) in seeded order.

    ``place`` is the row's number in that order before short texts are left out; states are cut at ``most``
    characters.
    """
    held = rows.select(F.col(id_col).cast("string").alias("id"), text.alias("state"), label.cast("int").alias("label"), F.to_json(F.struct(*extra)).alias("extra"))
    placed = consecutive(held.withColumn("_h", F.struct(seeded(seed, "id").alias("h"), "id")), "_h", "place").drop("_h")
    return placed.filter(F.length("state") >= least).select(F.lit(source).alias("source"), "id", F.substring("state", 1, most).alias("state"), "label", "place", "extra")


def legacy_converted(rows: DataFrame, task: str = "legacy") -> DataFrame:
    """``rows`` with ``prompt``, ``labels``, ``target_index``, ``target``, ``task`` and ``problem``: questions as historical training rows.

    ``rows`` hold a question each (state, type, instructions, names, descriptions, label, src). ``label`` is
    JSON: of a choice the name of an option or its number, of a score a number, in quotes or not; true, 1,
    "yes" and "true" mean yes and all else no. Fractions are cut. A choice of more than 26 options and a
    label that names nothing have a problem and no row of their own values: they stay, to be counted.
    Yes and no are shown as a choice of no and yes, with the descriptions given in that order.
    """
    kind, label, names = F.col("type"), F.col("label"), F.col("names")
    quoted = label.startswith('"')
    plain = F.when(quoted, F.from_json(F.concat(F.lit('{"v":'), label, F.lit("}")), "v string")["v"]).otherwise(label)
    whole = F.when(label == "true", 1).when(label == "false", 0).when(plain.rlike("^-?[0-9]{1,9}$") | (~quoted & plain.rlike("^-?[0-9]{1,9}[.][0-9]+$")), plain.cast("double").cast("int"))
    named = F.when(F.array_contains(names, plain), (F.array_position(names, plain) - 1).cast("int"))
    index = F.when(kind == "choice", F.when(quoted, named).otherwise(whole)).when(kind == "score", whole)
    yes = F.coalesce(label.isin("true", "1", "1.0", '"yes"', '"true"'), F.lit(False)).cast("int")
    shown = F.when(kind == "noul", F.array(F.lit("no"), F.lit("yes"))).otherwise(names)
    n = F.coalesce(F.size(shown), F.lit(0))
    at = F.when(kind == "noul", yes).otherwise(F.when(index.between(0, n - 1), index))
    described = F.transform(shown, lambda _, i: F.get("descriptions", i))
    asked = F.when(kind == "score", render.legacy_score(F.col("state"), F.col("instructions"), shown)).otherwise(render.legacy_choice(F.col("state"), F.col("instructions"), shown, described))
    problem = F.when(~F.coalesce(kind.isin("choice", "score", "noul"), F.lit(False)), "unknown type").when(n > 26, "more options than letters").when(at.isNull(), "label names no option").when(asked.isNull(), "no state or instructions")
    fine = lambda c: F.when(F.col("problem").isNull(), c)
    out = rows.withColumn("problem", problem)
    return out.withColumns({
        "prompt": fine(asked),
        "labels": fine(F.transform(shown, lambda _, i: F.concat(F.lit(" "), render.letter(i)))),
        "target_index": fine(at),
        "target": fine(prob.one_hot(at, n)),
        "task": fine(F.concat_ws(":", F.lit(task), F.coalesce("src", F.lit("?")))),
    })
