"""Filters, validators and their counters. Rejections are columns, so that nothing goes unreported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import text
from assay.functions.prob import let


def drop_sources(rows: DataFrame, *blocked: str) -> DataFrame:
    return rows.filter(~F.col("source").isin(*blocked))


def drop_wide(rows: DataFrame, most: int) -> DataFrame:
    """Choices of more than ``most`` options go."""
    return rows.filter((F.col("primitive") != "choice") | (F.col("k") <= most))


def overconfident(missing: Column, confidence: Column, answer_name: Column, limit: float) -> Column:
    """Disposition of a row: kept, exempt because the confident answer says unknown, or dropped."""
    unknown = F.coalesce(text.names_unknown(answer_name), F.lit(False))
    return F.when(~missing | (confidence < limit), "kept").when(unknown, "exempt_unknown").otherwise("dropped_overconfident")


def substantive(missing: Column, removed: Column, confidence: Column, answer_name: Column, limit: float) -> Column:
    """Reason to drop a patch example, or null: confident in substance without evidence; or still confident once it is removed."""
    sure = (confidence >= limit) & ~F.coalesce(text.names_unknown(answer_name), F.lit(False))
    return F.when(missing & sure, "confident_without_evidence").when(removed & sure, "confident_after_removal")


def counted(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def label_index(kind: Column, label: Column, options: Column) -> Column:
    """Position of a gold label (text of a JSON scalar) among the options; null where its type or value is wrong."""
    number = F.when(label.rlike("^(0|[1-9][0-9]*)$"), label.cast("int"))
    return (
        F.when(kind == "noul", F.when(label == "true", 1).when(label == "false", 0))
        .when(kind == "score", F.when((number >= 0) & (number < F.size(options)), number))
        .otherwise(F.when(F.array_contains(options, label), F.array_position(options, label) - 1))
        .cast("int")
    )


def question_problem(kind: Column, names: Column, descriptions_null: Column) -> Column:
    """Why a question isn't valid, or null. ``names``: options, levels or the keys given for yes/no."""
    n = F.coalesce(F.size(names), F.lit(0))
    return (
        F.when(~kind.isin("choice", "score", "noul"), "unknown type")
        .when((kind == "choice") & ~n.between(1, 255), "a choice has 1 to 255 options")
        .when((kind == "choice") & F.exists(names, lambda x: x == ""), "an option without a name")
        .when((kind == "score") & ~n.between(2, 10), "a score has 2 to 10 levels")
        .when((kind == "score") & descriptions_null, "a level without a description")
        .when((kind == "noul") & F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda x: ~x.isin("true", "false")), "only true and false are described")
    )


#: The most characters of a state's compact JSON by length tier, and the options of a generated choice.
TIERS = {"short": 500, "medium": 2500, "long": 6500}
OPTIONS = (3, 26)


def scenario_problem(kind: Column, wanted: Column, options: Column, expected: Column, state: Column, tier: Column) -> Column:
    """Why a generated scenario isn't valid, or null: the first problem of its question, its expected answer, its state.

    ``wanted`` and ``tier`` are its cell's; ``options`` the names or levels, ``expected`` the text of a JSON
    scalar, ``state`` compact JSON. A null state, an unknown tier and a null type are problems too.
    """
    n = F.coalesce(F.size(options), F.lit(0))
    unfit = label_index(kind, expected, options).isNull()
    most = F.element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), tier)
    return (
        F.when(~kind.eqNullSafe(wanted) | kind.isNull(), "primitive mismatch")
        .when(question_problem(kind, F.when(kind != "noul", options), F.lit(False)).isNotNull(), "invalid question")
        .when((kind == "choice") & unfit, "expected not among options")
        .when((kind == "choice") & ~n.between(*OPTIONS), "choice option count out of range")
        .when((kind == "score") & unfit, "expected level out of range")
        .when((kind == "noul") & unfit, "expected must be a boolean")
        .when(state.isNull() | ~F.substring(state, 1, 1).isin('"', "{", "["), "state must be a string, object, or array")
        .when(most.isNull(), "unknown tier")
        .when(F.length(state) > most, "state too long for its tier")
    )


def containment(docs: DataFrame, items: DataFrame, id_col: str, item_col: str, text_col: str = "text", least: int = 4) -> DataFrame:
    """(id, item): texts that contain an item's text verbatim, by an equi-join on an anchor of each item.

    An item's anchor is its longest inner word run of ``least`` words; documents are exploded into the
    same runs, matched by hash, and only matches are compared whole. Items of fewer words than the
    anchor are compared by their own first word's run instead, so they must have ``least`` + 2 words;
    shorter ones are left to a plain containment join over those few items.
    """
    runs = lambda c: F.split(c, " ")
    own = items.select(F.col(item_col), F.col(text_col).alias("_item"), runs(F.col(text_col)).alias("_w"))
    long, short = own.filter(F.size("_w") >= least + 2), own.filter(F.size("_w") < least + 2).drop("_w")
    anchor = F.array_join(F.slice("_w", 2, least), " ")
    anchored = long.select(item_col, "_item", F.xxhash64(anchor).alias("_h"))
    held = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    hashed = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - least + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, least), " ")))
    keys = docs.select(F.col(id_col), F.explode(F.array_distinct(let(runs(F.col(text_col)), hashed))).alias("_h"))
    hits = keys.join(anchored.select(item_col, "_h"), "_h").select(id_col, item_col).distinct()
    full = hits.join(held.select(id_col, "_text"), id_col).join(anchored.select(item_col, "_item"), item_col).filter(F.contains("_text", "_item")).select(id_col, item_col)
    rest = held.select(id_col, "_text").join(short, F.contains("_text", "_item")).select(id_col, item_col)
    return full.unionByName(rest)
