"""Upstream records to canonical examples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import prob, text

from .filters import label_index, question_problem

#: Fixed source that importers leave out, metadata that a record must have, and the widest choice for letters.
BLOCKED, MAX_OPTIONS = "sst5", 26
META = ("id", "group_id", "source", "repo", "revision", "split", "variant")
EXAMPLE = "state string, qid string, type string, instructions string, names array<string>, descriptions array<string>, label string, src string, meta map<string,string>, problem string"


def _questions(line: str) -> list[tuple]:
    """The questions of one record, each as a row of ``EXAMPLE``; one row with the problem if it can't be read."""
    try:
        row = text.parse(line)
        if not isinstance(row, dict):
            raise text.JSONRejected("not an object")
        meta, asked = row.get("_meta"), row.get("questions")
        if not isinstance(meta, dict) or any(not isinstance(meta.get(m), str) or not meta[m] for m in META):
            raise text.JSONRejected("metadata missing")
        if not isinstance(row.get("state"), (str, list, dict)):
            raise text.JSONRejected("state is not text, a list or an object")
        if not isinstance(asked, dict) or not asked:
            raise text.JSONRejected("no questions")
    except text.JSONRejected as e:
        return [(None,) * 9 + (str(e),)]
    out = []
    for qid, spec in asked.items():
        spec = spec if isinstance(spec, dict) else {}
        given, label = spec.get("criteria"), spec.get("label")
        names = list(given) if isinstance(given, dict) else [str(i) for i in range(len(given))] if isinstance(given, list) else None
        told = [v if v is None or isinstance(v, str) else text.compact(v) for v in (given.values() if isinstance(given, dict) else given)] if names is not None else None
        kind = spec.get("type")
        typed = {"choice": str, "noul": bool, "score": int}.get(kind)
        shown = (label if isinstance(label, str) else text.compact(label)) if typed and type(label) is typed else None
        out.append((text.compact(row["state"]), qid, kind, text.compact(spec.get("instructions")), names, told, shown, spec.get("src"), {m: meta[m] for m in META}, None))
    return out


def exploded(rows: DataFrame, line_col: str, keep: list[str]) -> DataFrame:
    """A row for each question of each record, with the kept columns."""
    names = [f.split()[0] for f in EXAMPLE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*k, *q) for *k, line in pdf.itertuples(index=False) for q in _questions(line or "")]
            yield pd.DataFrame(out, columns=[*keep, *names])

    held = rows.select(*keep, line_col)
    kept = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in keep)
    return held.mapInPandas(run, f"{kept}, {EXAMPLE}" if keep else EXAMPLE)


def upstream_examples(rows: DataFrame, line_col: str = "line", keep: list[str] | None = None, max_options: int = MAX_OPTIONS) -> DataFrame:
    """Canonical examples of upstream JSON lines: ``id, group_id, source, state, ..., target, reject_reason``.

    Nothing is dropped: a record that can't be read, an invalid question, a label of the wrong type or
    value, the blocked source and wide choices keep their row with a reason, for ``reject_counts``.
    """
    keep = keep or []
    q = exploded(rows, line_col, keep)
    keys = F.when(F.col("type") == "noul", F.array(F.lit("no"), F.lit("yes"))).otherwise(F.col("names"))
    q = q.withColumn("answer_keys", keys).withColumn("target_index", label_index(F.col("type"), F.col("label"), F.col("answer_keys")))
    wrong = question_problem(F.col("type"), F.col("names"), F.exists(F.coalesce("descriptions", F.array().cast("array<string>")), lambda d: d.isNull()))
    reason = (
        F.when(F.isnotnull("problem"), F.col("problem"))
        .when(wrong.isNotNull(), wrong)
        .when(F.coalesce("src", F.lit("")) == "", "question without a source")
        .when(F.isnull("target_index"), "label is not an answer")
        .when((F.col("src") == BLOCKED) | (F.col("meta.source") == BLOCKED), BLOCKED)
        .when((F.col("type") == "choice") & (F.size("names") > max_options), "wide_choice")
    )
    m = lambda name: F.col(f"meta.{name}")
    return q.select(
        *keep,
        text.identity_key(m("repo"), m("id"), m("variant"), F.col("qid")).alias("id"),
        F.concat(F.lit("upstream:"), m("repo"), F.lit(":"), m("group_id")).alias("group_id"),
        F.concat(F.lit("upstream:"), F.col("src")).alias("source"),
        "state", "qid", "type", "instructions", "names", "descriptions", "answer_keys", "target_index",
        F.when(F.isnotnull("target_index"), prob.one_hot(F.col("target_index"), F.size("answer_keys"))).alias("target"),
        F.lit("gold").alias("target_origin"),
        reason.alias("reject_reason"),
    )


def reject_counts(examples: DataFrame) -> DataFrame:
    return examples.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def assert_unique(rows: DataFrame, key: str = "id") -> None:
    """Fails if an identity occurs twice."""
    if bad := rows.groupBy(key).count().filter("count > 1").limit(1).collect():
        raise ValueError(f"duplicate identity {bad[0][key]}")
