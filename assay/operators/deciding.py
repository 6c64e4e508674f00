"""Questions asked of states: views, scores, recombination, priors by question, temperatures, typed answers.

Under the letter readout a question is one prompt whose labels are its options. Under the candidate readout each
option of a choice and each level of a score is a yes/no prompt of its own, and the shares of yes make up the
distribution; a yes/no question is one prompt either way. Prompts are scored where they are rendered and never
shuffled or written: states are made distinct instead. A state's equal prompts are scored once, and a scorer
that can go on from a prefix reads a state once for all its prompts that begin alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import prob, render, text
from assay.storage import bounded_batches

from . import calibrate, pairing

LETTERS, CANDIDATE = "letters", "candidate"
#: Fixed states without content, whose mean answer is a question's prior; as JSON.
CONTENT_FREE = ['"N/A"', '""', '"none"']
#: Questions at most: they are part of the plan, each row meets all of them.
MOST_QUESTIONS = 256


def as_column(questions: DataFrame) -> Column:
    """A small table (qid, type, instructions, names, descriptions) as an array of structs, so that rows meet it without a join."""
    held = questions.select("qid", "type", "instructions", "names", "descriptions").limit(MOST_QUESTIONS + 1).collect()
    if len(held) > MOST_QUESTIONS:
        raise ValueError(f"at most {MOST_QUESTIONS} questions at once")
    texts = lambda xs: F.lit(None).cast("array<string>") if xs is None else F.array(*[F.lit(x).cast("string") for x in xs]).cast("array<string>")
    each = []
    for q in held:
        if q["type"] not in ("noul", "choice", "score"):
            raise ValueError(f"unknown type of question: {q['type']}")
        names, told = (["no", "yes"], [None, None]) if q["type"] == "noul" else (q["names"], q["descriptions"])
        if not names or len(told or []) != len(names):
            raise ValueError(f"{q['qid']}: a description, null perhaps, for each of its options")
        each.append(F.struct(F.lit(q["qid"]).alias("qid"), F.lit(q["type"]).alias("type"), F.lit(q["instructions"]).alias("instructions"), texts(names).alias("keys"), texts(told).alias("told")))
    kind = "array<struct<qid: string, type: string, instructions: string, keys: array<string>, told: array<string>>>"
    return F.array(*each).cast(kind)


def prompts(readout: str, state: Column, q: Column) -> Column:
    """The prompts of a question's views, in order of its options. A score's levels don't see each other."""
    asked = text.json_string(q["instructions"])
    options = F.zip_with(q["keys"], q["told"], render.option_json)
    whole = F.array(render.structured(state, q["type"], asked, options))
    if readout == LETTERS:
        return whole
    if readout != CANDIDATE:
        raise ValueError(f"unknown readout: {readout}")
    pairs = F.zip_with(q["keys"], q["told"], lambda n, d: F.concat(text.json_string(n), F.lit(":"), F.coalesce(text.json_string(d), F.lit("null"))))
    alternatives = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    candidates = F.when(q["type"] == "choice", options).otherwise(F.transform(q["told"], lambda d: F.coalesce(text.json_string(d), F.lit("null"))))
    return F.when(q["type"] == "noul", whole).otherwise(F.transform(candidates, lambda c: render.candidate(state, q["type"], asked, alternatives, c)))


def _from_prefixes(scorer: calibrate.PrefixScorer):
    """Vectors of a row's prompts. A state's last prefix under each head is kept, with what was scored after it."""
    held: dict[str, tuple[str, object, dict]] = {}

    def one(prompt: str, n: int, length: int) -> list[float]:
        head = prompt[: prompt.index(render.STATE) + len(render.STATE)]
        prefix, suffix = prompt[: len(head) + length], prompt[len(head) + length :]
        if head not in held or held[head][0] != prefix:
            held[head] = (prefix, scorer.begin(prefix), {})
        _, state, done = held[head]
        if (suffix, n) not in done:
            done[suffix, n] = scorer.finish(state, suffix, n)
        return done[suffix, n]

    return lambda rows: [[one(prompt, n, length) for prompt in prompts] for prompts, n, length in rows]


def _at_once(scorer: calibrate.Scorer):
    """Vectors of a batch's prompts, equal ones scored once."""

    def run(rows: list[tuple[list[str], int, int]]) -> list[list[list[float]]]:
        asked = list(dict.fromkeys((prompt, n) for prompts, n, _ in rows for prompt in prompts))
        found = dict(zip(asked, scorer.score([prompt for prompt, _ in asked], [n for _, n in asked]) if asked else []))
        return [[found[prompt, n] for prompt in prompts] for prompts, n, _ in rows]

    return run


def _scored(scorer: calibrate.Scorer):
    """Batches (prompts, labels of each, length of the state, further columns) with ``v``, a vector for each prompt, in place of the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = (_from_prefixes if isinstance(scorer, calibrate.PrefixScorer) else _at_once)(scorer)
        for batch in batches:
            rows = [([p for p in prompts if p is not None], n, length or 0) for prompts, n, length in zip(*[batch.column(i).to_pylist() for i in range(3)])]
            v = pa.array([x or None for x in score(rows)], pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], v], [*batch.schema.names[3:], "v"])

    return run


def distributions(rows: DataFrame, questions: Column, scorer: calibrate.Scorer, readout: str = LETTERS) -> DataFrame:
    """(row, q, p) of ``rows`` (row, state): each question's distribution over its keys; null for a null state."""
    bounded_batches(rows.sparkSession)
    asked = rows.select("row", "state", F.explode(questions).alias("q"))
    single = F.lit(readout == LETTERS) | (F.col("q.type") == "noul")
    n_labels = F.when(single, F.size("q.keys")).otherwise(2)
    views = asked.select(prompts(readout, F.col("state"), F.col("q")).alias("prompts"), n_labels.alias("n"), F.length("state").alias("length"), "row", "q")
    schema = T.StructType([*views.schema.fields[3:], T.StructField("v", T.ArrayType(T.ArrayType(T.DoubleType())))])
    scored = views.mapInArrow(_scored(scorer), schema)
    combined = prob.normalise(F.transform("v", lambda x: F.get(x, F.lit(1))))
    return scored.select("row", "q", F.when(single, F.get("v", F.lit(0))).otherwise(combined).alias("p"))


def content_free_priors(spark: SparkSession, questions: Column, scorer: calibrate.Scorer, readout: str = LETTERS) -> DataFrame:
    """(qid, prior): the mean distribution of each question over the states without content."""
    states = spark.createDataFrame(list(enumerate(CONTENT_FREE)), "row long, state string")
    cells = distributions(states, questions, scorer, readout).select("q.qid", F.posexplode("p").alias("i", "v")).groupBy("qid", "i").agg(F.avg("v").alias("m"))
    return cells.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("prior"))


def decide(rows: DataFrame, questions: DataFrame, scorer: calibrate.Scorer, id_col: str = "id", state_col: str = "state", readout: str = LETTERS, contextual: bool = False, fits: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """(id, qid, type, answer, p): each question asked of each state, a JSON string.

    ``questions`` is (qid, type, instructions, names, descriptions), of ``MOST_QUESTIONS`` at most; question ids never
    reach a prompt. With ``contextual`` the question's own content-free prior is divided out, else ``prior`` (qid,
    prior) if given; then the primitive's temperature of ``fits`` applies. Rows that share an id are asked each; a null
    state has null answers.
    """
    column = as_column(questions)
    held = rows.select(F.col(id_col).alias("id"), F.col(state_col).alias("state"))
    # a state is asked once, however many rows have it
    out = distributions(held.select("state").distinct().withColumn("row", F.sha2("state", 256)), column, scorer, readout)
    if contextual:
        prior = content_free_priors(rows.sparkSession, column, scorer, readout)
    out = out.select("row", "q.qid", F.col("q.type").alias("type"), "q.keys", "p")
    if prior is not None:
        out = out.join(prior, "qid", "left").withColumn("p", F.when(F.isnotnull("prior"), prob.contextual(F.col("p"), F.col("prior"))).otherwise(F.col("p")))
    out = out.withColumn("primitive", F.col("type"))
    if fits is not None:
        out = pairing.with_temperature(out, fits).withColumn("p", prob.temperature_scale(F.col("p"), F.col("temperature")))
    answers = out.select("row", "qid", "type", F.when(F.isnotnull("p"), prob.typed_answer(F.col("type"), F.col("keys"), F.col("p"))).alias("answer"), "p")
    return held.select("id", F.sha2("state", 256).alias("own")).join(answers, F.col("own").eqNullSafe(F.col("row"))).select("id", "qid", "type", "answer", "p")
