"""Perspective rotation: a dialogue once for every participant, who speaks as the assistant.

The result is kept by turn: each row is one rendered segment of one perspective, with its place in the
whole rendering, so that a conversation of any length, even one that holds a third of all turns, is
never one row or one task. ``render`` joins the segments of conversations into single texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one block of the running offsets.
BLOCK = 256
#: Fixed values of the format: the role that no participant has, and what stands around a turn.
SYSTEM, ASSISTANT, USER = "system", "assistant", "user"
END = "<|end|>\n"


def _header(role: Column, name: Column) -> Column:
    return F.when(role == USER, F.concat(F.lit("<|user name="), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), role, F.lit("|>\n")))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each perspective and turn: ``conv_id, turn, perspective, role, name, segment, start, mask_start, mask_end, trained``.

    ``perspective`` is each distinct speaker of the conversation but ``system``; a null speaker is
    named ``unknown``. ``start`` counts the characters of the rendering before the segment; the mask
    spans the characters to learn from: the perspective's own words and the end mark, empty elsewhere.
    A conversation of system turns only has no participant and gives no rows. A null text is empty;
    null conversations are one conversation, null turns come first; turns that tie are ordered by
    speaker and text, and repeated rows stay repeated. An empty table gives an empty result; further
    columns are not read.
    """
    said = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    casts = said.filter(F.col("name") != SYSTEM).select(F.col("conv_id").alias("own"), F.col("name").alias("perspective")).distinct()
    each = said.join(casts, F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")
    role = F.when(F.col("name") == SYSTEM, SYSTEM).when(F.col("name") == F.col("perspective"), ASSISTANT).otherwise(USER)
    each = each.withColumn("role", role).withColumn("header", _header(F.col("role"), F.col("name")))
    each = each.withColumn("segment", F.concat("header", "text", F.lit(END)))
    each = each.withColumn("size", F.length("segment").cast("bigint")).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))))
    # offsets in two steps, so that one long conversation is many windows
    before = Window.partitionBy("own", "view").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    bases = each.groupBy(F.col("conv_id").alias("own"), F.col("perspective").alias("view"), F.col("block").alias("number")).agg(F.sum("size").alias("held"))
    bases = bases.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    same = F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("perspective") == F.col("view")) & (F.col("block") == F.col("number"))
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.asc_nulls_first("turn"), "name", "text").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, same)
    start = F.col("base") + F.col("inside")
    trained = F.col("role") == ASSISTANT
    body = start + F.length("header")
    return each.select("conv_id", "turn", "perspective", "role", "name", "segment", start.alias("start"), body.alias("mask_start"), F.when(trained, start + F.col("size")).otherwise(body).alias("mask_end"), trained.alias("trained"))


def render(turns: DataFrame, **columns) -> DataFrame:
    """One row for each conversation and perspective: its whole text and the spans to learn from.

    For conversations that fit a row; the order and spans are those of ``rotate``.
    """
    each = rotate(turns, **columns)
    ordered = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end", "trained")))
    held = each.groupBy("conv_id", "perspective").agg(ordered.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["mask_start"].alias("start"), t["mask_end"].alias("end")))
    return held.select("conv_id", "perspective", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("rendered"), spans.alias("masks"))
