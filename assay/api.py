"""Entry points that carry work from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import prob, render, text
from .operators import calibrate, groups, importing, metrics, pairing, resample
from .operators.deciding import decide  # noqa: F401
from .sources import artifacts, readers, sinks
from .storage import materialize


def evaluate(predictions: DataFrame) -> DataFrame:
    """The whole report by grouping set."""
    return metrics.evaluation(predictions)


def compare(first: DataFrame, second: DataFrame, samples: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(fidelity by primitive, bootstrap intervals of second minus first) of two runs of the same examples."""
    pair = materialize(pairing.pair_runs(first, second), "pair")
    return pair.groupBy("primitive").agg(*metrics.fidelity(pair)), resample.bootstrap(resample.paired_deltas(pair), samples)


def fit_workload(predictions: DataFrame, workload: str, config: dict, least: int = 25) -> tuple[dict, DataFrame]:
    """(artifact of the fits that may be used, diagnostics of all); fails if none may be used."""
    found = materialize(calibrate.with_verdicts(predictions, calibrate.fit_temperatures(predictions), least), "fits")
    return artifacts.build(found.filter("applied"), config, workload), found


def prepare(train: DataFrame, test: DataFrame, path: str, line_col: str = "line", development: float = 0.1, calibration: float = 0.1) -> dict:
    """Upstream JSON lines to leakage-safe, written partitions with a manifest.

    Questions become examples; examples that share an id, a group or a content key fall into one
    group; training groups that touch the test set are removed; the rest is cut by groups.
    """
    def read(lines: DataFrame, role: str) -> DataFrame:
        out = importing.upstream_examples(lines, line_col).withColumn("role", F.lit(role))
        bad = out.filter("reject_reason is not null and reject_reason not in ('sst5', 'wide_choice')").limit(1).collect()
        if bad:
            raise ValueError(bad[0]["reject_reason"])
        return out.filter("reject_reason is null").withColumn("content", text.content_key(F.col("state")))

    rows = materialize(read(train, "train").unionByName(read(test, "test")), "examples")
    importing.assert_unique(rows)
    edges = materialize(pairing.leakage_edges(rows.withColumn("group", F.concat(F.lit("group:"), "group_id")), "id", "group", "content"), "edges")
    parts = materialize(groups.split(edges, rows.filter("role = 'test'").select("id"), development, calibration), "split")
    groups.assert_disjoint(edges, parts)
    held = rows.drop("role", "reject_reason", "content").join(parts.select("id", "split"), "id")
    names = ("train", "development", "calibration", "test")
    return sinks.write_dataset({n: held.filter(F.col("split") == n).drop("split") for n in names}, path)


def audit(paths: str, spark) -> DataFrame:
    """Formats and row counts of many files."""
    return readers.sniffed(spark, paths)
