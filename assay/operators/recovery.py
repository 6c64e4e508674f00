"""Historical prompts back to state and question, by the one phrasing that renders to them.

A phrasing's rendering is a frame: what stands before the state and what stands after it. A prompt falls into
its own frame and state in one way, so that the phrasings that render to it are those with an equal
frame and equal labels: an equi-join, however many phrasings there are, in place of a rendering of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import render

#: Fixed marks of the historical formats.
STATE, QUESTION = "State:\n", "\n\nQuestion:"


def framed(prompt: Column) -> tuple[Column, Column, Column]:
    """(head, state, tail): the state stands from the first mark of a state to the last mark of a question. Null where either is absent."""
    at = F.instr(prompt, STATE)
    head = F.substring(prompt, F.lit(1), at + len(STATE) - 1)
    rest = F.substring(prompt, at + len(STATE), F.length(prompt))
    after = F.length(F.substring_index(rest, QUESTION, -1)) + len(QUESTION)
    fine = (at > 0) & (F.length(rest) >= after)
    state = F.substring(rest, F.lit(1), F.length(rest) - after)
    tail = F.substring(rest, F.length(rest) - after + 1, after)
    return F.when(fine, head), F.when(fine, state), F.when(fine, tail)


def frames(phrasings: DataFrame) -> DataFrame:
    """(head, tail, labels, n, phrasing) of a table (phrasing, type, instructions, names, descriptions): how many phrasings have a frame, and the first of them.

    ``type`` is ``score`` (names are its levels) or ``choice``; a yes/no question is a choice of no and yes.
    """
    none = F.lit("")
    shown = F.when(F.col("type") == "score", render.legacy_score(none, F.col("instructions"), F.col("names"))).otherwise(render.legacy_choice(none, F.col("instructions"), F.col("names"), F.col("descriptions")))
    cut = F.instr(shown, STATE) + len(STATE)
    labels = render.labels(F.size("names"))
    parts = phrasings.select("phrasing", F.substring(shown, F.lit(1), cut - 1).alias("head"), F.substring(shown, cut, F.length(shown)).alias("tail"), labels.alias("labels"))
    return parts.groupBy("head", "tail", "labels").agg(F.count("*").alias("n"), F.min("phrasing").alias("phrasing"))


def recover(rows: DataFrame, phrasings: DataFrame, prompt_col: str = "prompt", labels_col: str = "labels") -> DataFrame:
    """``rows`` with ``state``, ``phrasing`` and ``reason``, which is null where exactly one phrasing renders to the prompt and its labels.

    Else state and phrasing are null, and the reason is ``no frame`` (no state or no question in the prompt),
    ``unmatched`` or ``ambiguous``. No row is left out or repeated, and texts may have any length.
    """
    head, state, tail = framed(F.col(prompt_col))
    held = rows.withColumns({"_head": head, "_state": state, "_tail": tail})
    known = frames(phrasings).select(F.col("head").alias("_h"), F.col("tail").alias("_t"), F.col("labels").alias("_l"), F.col("n").alias("_n"), "phrasing")
    found = held.join(known, (F.col("_head") == F.col("_h")) & (F.col("_tail") == F.col("_t")) & (F.col(labels_col) == F.col("_l")), "left")
    reason = F.when(F.col("_head").isNull(), "no frame").when(F.col("_n").isNull(), "unmatched").when(F.col("_n") > 1, "ambiguous")
    found = found.withColumn("reason", reason)
    alone = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    return found.withColumns({"state": alone("_state"), "phrasing": alone("phrasing")}).drop("_head", "_state", "_tail", "_h", "_t", "_l", "_n")
