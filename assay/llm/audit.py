"""How filters interact: counts of all their intersections, and what follows from them.

One aggregate counts, for every set of filters, the documents that fail them all, as sums of products of
flags. Everything else is arithmetic on these 32 numbers: survivors of any prefix by inclusion and
exclusion, documents that fail a single filter by Möbius inversion, and Shapley values from the
dividends of the game whose worth is the number of removed documents, which are the same counts with
alternating signs. No order of filters is ever run over the documents.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.storage import materialize

from .exprs import let, words

FILTERS = "ABCDE"


def text_flags(text: Column) -> Column:
    """Bits 0 to 3 of the filters A to D of a text that is not null: short, repetitive, capitals, symbols."""
    size = lambda x: F.size(x).cast("bigint")
    bits = lambda *tests: reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(tests)])
    capitals = F.coalesce(F.regexp_count(text, F.lit("[A-Z]")), F.lit(0)).cast("bigint")
    counts = let(words(text), lambda w: F.struct(size(w).alias("n"), size(F.array_distinct(w)).alias("distinct")))
    short = let(counts, lambda c: bits(c["n"] < 200, 100 * c["distinct"] < 50 * c["n"]))
    return short + 4 * bits(100 * capitals > 3 * F.char_length(text), text.rlike("[#$%&*|]"))


def failing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, n): how many rows of an id and part fail which of the five filters.

    Texts are compared by SHA-256 of their bytes. Equal rows are counted before anything is joined, and a
    text's first id is met on text and id together, so neither a text, an id nor a row that a third of
    the table shares gathers in one task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("digest"), text_flags(F.col("text")).alias("mask"))
    rows = materialize(rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "failing")
    firsts = rows.filter(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    marked = rows.join(firsts, ["digest", "id"], "left").withColumn("mask", F.col("mask") + F.when(copy, 16).otherwise(0))
    return marked.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))


def interactions(cases: DataFrame, filters: str = FILTERS, tallies: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """The report on every order of ``filters`` and every step, for each part.

    ``cases`` has ``part``, ``mask`` (bit i: fails the i-th filter), ``n`` rows, and for each of ``tallies`` how many
    of these rows are of that kind; the report has ``<tally>_lost`` for each. Shapley values are sums over all
    orders, so that they are whole numbers. There are as many orders as the factorial of the filters: at
    most seven are taken. No cases give no rows.
    """
    if not 1 <= len(filters) <= 7 or len(set(filters)) < len(filters):
        raise ValueError("one to seven filters, each named by a letter of its own")
    sets, orders = 1 << len(filters), math.factorial(len(filters))
    flags = [F.shiftright("mask", i).bitwiseAND(F.lit(1)).cast("bigint") for i in range(len(filters))]
    of = lambda t: [flags[i] for i in range(len(filters)) if t >> i & 1]
    joint = lambda n: F.array(*[F.sum(reduce(lambda a, b: a * b, of(t), F.col(n))) for t in range(sets)])
    counts = cases.groupBy("part").agg(*[joint(n).alias(f"joint_{n}") for n in ("n", *tallies)])

    sign = lambda t: 1 - 2 * (t.bit_count() & 1)
    total = lambda terms: reduce(lambda a, b: a + b, terms)
    kept = lambda n: F.array(*[total([sign(t) * F.col(f"joint_{n}")[t] for t in range(sets) if not t & ~m]) for m in range(sets)])
    holding = lambda f, worth: total([-sign(t) * worth(t) * F.col("joint_n")[t] for t in range(sets) if t >> f & 1])
    each = lambda worth: F.array(*[holding(f, worth) for f in range(len(filters))])
    counts = counts.select(
        "part", F.col("joint_n").alias("joint"), *[kept(n).alias(f"kept_{n}") for n in ("n", *tallies)],
        each(lambda t: 1).alias("unique"), each(lambda t: orders // t.bit_count()).alias("dividends"),
    )

    named = counts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])))
    steps = named.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    before = total([F.when(F.instr("filter_order", c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(filters)])
    steps = steps.withColumn("f", F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1).withColumn("before", before)
    bit = F.call_function("shiftleft", F.lit(1), F.col("f"))
    at = lambda name, i: F.element_at(name, i + 1)
    lost = lambda n: at(f"kept_{n}", F.col("before")) - at(f"kept_{n}", F.col("before") + bit)
    return steps.select(
        "part", "filter_order", "step", at("kept_n", F.col("before") + bit).alias("kept"), lost("n").alias("removed"),
        (at("joint", bit) - lost("n")).alias("redundant"), at("unique", F.col("f")).alias("unique_fails"),
        *[lost(n).alias(f"{n}_lost") for n in tallies], at("dividends", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``interactions`` of the five filters over whole texts, with labelled good and toxic documents lost.

    A null text is the empty text, a null part the empty string. A null id is neither smaller nor larger than
    another, so its text is no copy and makes none; it has no labels. Every row counts, repeated ones too;
    rows that share id and text are no copies of each other. A document is good (toxic) if any label row of
    its id says 1. Texts of any length are read whole. An empty table gives no rows. Further columns are
    not read.
    """
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("bigint")).alias("good"), F.max((F.col("toxic") == 1).cast("bigint")).alias("toxic"))
    cases = failing(docs, id_col, text_col, part_col).join(marks, "id", "left")
    mark = lambda name: (F.col("n") * F.coalesce(name, F.lit(0))).alias(name)
    return interactions(cases.select("part", "mask", "n", mark("good"), mark("toxic")))
