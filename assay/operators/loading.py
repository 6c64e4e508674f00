"""Training rows in one call: canonical examples rendered as views, or historical pre-rendered prompts checked.

Every row has ``prompt``, ``labels``, ``target``, ``task``, ``id``, ``example_id``, ``renderer_version``,
``readout_version``, ``weight``, ``ordinal`` and ``leakage_keys``. Nothing is skipped: a row that can't be
trained on fails the job with its name and the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import prob, render, text

from . import deciding, training

STRUCTURED, LEGACY = "structured-v1", "legacy-v0"
COLUMNS = ["id", "example_id", "task", "prompt", "labels", "target", "weight", "ordinal", "leakage_keys", "renderer_version", "readout_version"]
_AFTER, _BEFORE = "State:\n", "\n\nQuestion:"


def _or_fail(value: Column, problem: Column, name: Column) -> Column:
    return F.when(problem.isNull(), value).otherwise(F.raise_error(F.concat(name.cast("string"), F.lit(": "), problem)))


def _legacy_prompt(state: Column, q: Column) -> Column:
    flat = text.flatten_state(state)
    return F.when(q["type"] == "score", render.legacy_score(flat, q["instructions"], q["told"])).otherwise(render.legacy_choice(flat, q["instructions"], q["keys"], q["told"]))


def canonical_rows(examples: DataFrame, renderer: str = STRUCTURED, readout: str = training.LETTERS) -> DataFrame:
    """Views of canonical examples (id, group_id, source, state, q, target); ``state`` is JSON.

    ``q`` is a struct (type, instructions, keys, told): options with a description, null perhaps, for each;
    the keys of a score are its levels' numbers, those of a yes/no question ``no`` and ``yes``. Letters make
    one view of an example. Candidates make one for each option of a choice and each level of a score; they
    weigh one together. An example with a null or malformed part, a target that isn't a distribution over
    its options, or more options than letters in one prompt, fails the job. Texts of any length are rendered
    whole; an empty table gives an empty one, and rows that repeat come back repeated.
    """
    if renderer not in (STRUCTURED, LEGACY) or readout not in (training.LETTERS, training.CANDIDATE):
        raise ValueError(f"unknown renderer or readout: {renderer}, {readout}")
    if readout == training.CANDIDATE and renderer != STRUCTURED:
        raise ValueError("candidates are rendered in the structured format only")
    held = examples.select("id", "group_id", "source", "state", "q", "target")
    q, n = F.col("q"), F.coalesce(F.size("q.keys"), F.lit(0))
    lettered = F.lit(readout == training.LETTERS) | (F.col("q.type") == "noul")
    fine_target = prob.target_normalised(F.col("target"), n)
    problem = (
        F.when(F.isnull("id") | F.isnull("group_id") | F.isnull("source"), "no id, group or source")
        .when(F.isnull("state"), "no state")
        .when(F.isnull("q.instructions") | ~F.coalesce(F.col("q.type").isin("noul", "choice", "score"), F.lit(False)), "no question")
        .when((n < 1) | (F.coalesce(F.size("q.told"), F.lit(0)) != n) | F.exists("q.keys", lambda k: k.isNull()) | (F.size(F.array_distinct("q.keys")) < n), "options are not named once each")
        .when((F.col("q.type") == "score") & F.exists("q.told", lambda d: d.isNull()), "a level has no description")
        .when(lettered & (n > render.LETTERS), "more options than letters")
        .when(fine_target.isNull(), "not a target")
    )
    held = held.withColumn("target", _or_fail(fine_target, problem, F.coalesce(F.col("id").cast("string"), F.lit("?"))))
    if renderer == LEGACY:
        prompts = F.array(_legacy_prompt(F.col("state"), q))
    else:
        prompts = deciding.prompts(deciding.LETTERS if readout == training.LETTERS else deciding.CANDIDATE, F.col("state"), q)
    keys = F.array_sort(F.array(F.concat(F.lit("example:"), F.col("id").cast("string")), F.concat(F.lit("group:"), F.col("group_id").cast("string")), text.content_key(F.col("state"))))
    made = held.withColumn("leakage_keys", keys).withColumn("prompts", prompts).withColumn("n", F.size("prompts"))
    views = made.select("*", F.posexplode("prompts").alias("view", "prompt"))
    yes = F.get("target", F.col("view"))
    return views.select(
        F.concat(F.col("id").cast("string"), F.lit("/view/"), F.col("view").cast("string")).alias("id"),
        F.col("id").cast("string").alias("example_id"),
        F.col("source").alias("task"),
        "prompt",
        render.labels(F.when(lettered, n).otherwise(2)).alias("labels"),
        F.when(lettered, F.col("target")).otherwise(F.array(1.0 - yes, yes)).alias("target"),
        (1.0 / F.col("n")).alias("weight"),
        ((F.col("q.type") == "score") & F.lit(readout == training.LETTERS)).alias("ordinal"),
        "leakage_keys",
        F.lit(renderer).alias("renderer_version"),
        F.lit(readout).alias("readout_version"),
    )


def prompt_state(prompt: Column) -> Column:
    """The state of a historical prompt: from behind the first mark of a state to the last mark of a question."""
    rest = F.substring(prompt, F.locate(_AFTER, prompt) + len(_AFTER), F.length(prompt))
    tail = F.substring_index(rest, _BEFORE, -1)
    return F.when(F.contains(rest, F.lit(_BEFORE)), F.substring(rest, F.lit(1), F.length(rest) - F.length(tail) - len(_BEFORE))).otherwise(rest)


def legacy_rows(rows: DataFrame, renderer: str | None = None, readout: str = training.LETTERS) -> DataFrame:
    """Historical rows (file, line_number, prompt, labels, target, task) as training rows; their only leakage key is that of the state's text.

    A row's id is its place. Only the letter readout and the historical renderer fit such rows.
    """
    if readout != training.LETTERS:
        raise ValueError("candidates need canonical examples, not historical prompts")
    if renderer not in (None, LEGACY):
        raise ValueError(f"historical prompts are of {LEGACY}")
    place = F.concat("file", F.lit(":"), F.col("line_number").cast("string"))
    problem = training.legacy_problem(F.col("prompt"), F.col("labels"), F.col("target"))
    target = _or_fail(prob.target_normalised(F.col("target"), F.size("labels")), problem, place)
    made = rows.select(place.alias("id"), "prompt", "labels", target.alias("target"), "task")
    key = text.content_key(text.json_string(prompt_state(F.col("prompt"))))
    return made.withColumns({
        "example_id": F.col("id"), "weight": F.lit(1.0), "ordinal": F.lit(False), "leakage_keys": F.array(key),
        "renderer_version": F.lit(LEGACY), "readout_version": F.lit(training.LETTERS),
    }).select(*COLUMNS)


def crossing(train: DataFrame, validation: DataFrame) -> DataFrame:
    """(key): leakage keys that training and validation rows share; empty if they may be used together."""
    keys = lambda df: df.select(F.explode("leakage_keys").alias("key")).distinct()
    return keys(train).join(keys(validation), "key", "left_semi")
