"""Temperature fits over any number of rows, and fits of bounded samples.

A fit is a safeguarded Newton search for the minimum in log T. One aggregate a round gives the value, the
slope and the curvature of every group at its own temperature, so rows are never gathered and each task
sends a few sums for each group; a handful of rounds reach 1e-6.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import prob

from . import metrics

LOWER, UPPER = 0.05, 20.0
#: A step of this size in log T ends a search: what Newton's next step would add is of the order of its square.
NEAR, ROUNDS = 1e-4, 60
#: Fixed thresholds of the verdicts: a material temperature, a structural error, a vanishing likelihood.
MATERIAL, STRUCTURAL, VANISHING = math.log(1.25), 0.10, 1e-6


class _Search:
    """The search of one group: where to evaluate next, and the best of what was seen. It starts at T = 1, or the bound nearest to it."""

    def __init__(self, lower: float, upper: float):
        if not 0 < lower < upper:
            raise ValueError("positive temperature bounds required")
        self.ends = self.a, self.b = math.log(lower), math.log(upper)
        self.at = min(max(0.0, self.a), self.b)
        self.done, self.best, self.seen = False, (math.inf, 0.0), set()

    def feed(self, loss: float, slope: float, spread: float) -> None:
        """Take the mean loss at ``at``, its slope in log T, and the mean variance of the logits under the fit."""
        u = self.at
        self.seen.add(u)
        self.best = min(self.best, (loss, u))
        if slope > 0:
            self.b = u
        else:
            self.a = u
        curvature = spread - slope
        if curvature > 0:
            step = -slope / curvature
        else:  # Newton in 1 / T, in which the loss is convex
            step = -math.log1p(slope / spread) if spread > 0 and slope > -spread else math.copysign(math.inf, -slope)
        if slope == 0 or self.b <= self.a:
            self.done = True
        elif abs(step) < NEAR and self.a <= u + step <= self.b:
            self.best = min(self.best, (loss + step * (slope + curvature * step / 2), u + step))
            self.done = True
        elif self.a < u + step < self.b:
            self.at = u + step
        else:  # beyond the bracket: the bound itself first, then halves
            end = self.ends[0] if step < 0 else self.ends[1]
            self.at = end if end in (self.a, self.b) and end not in self.seen else (self.a + self.b) / 2
            self.done = self.b - self.a < NEAR**2


def _evaluate(rows: DataFrame, by: str, points: dict[str, float]) -> dict[str, tuple[float, float, float]]:
    """(loss, slope, spread) of each group at its own log temperature; the groups are few and named. Clipped rows have no slope."""
    scale = F.element_at(F.create_map(*[x for g, u in points.items() for x in (F.lit(g), F.lit(math.exp(-u)))]), F.col(by))
    logs = F.transform("p", lambda v: F.ln(F.greatest(v, F.lit(prob.CLIP))) * scale)
    less = prob.let(logs, lambda z: prob.let(F.array_max(z), lambda m: F.transform(z, lambda v: v - m)))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("d"), F.lit(0.0).alias("dd"))
    add = lambda a, x: F.struct((a["s"] + x["e"]).alias("s"), (a["d"] + x["e"] * x["d"]).alias("d"), (a["dd"] + x["e"] * x["d"] * x["d"]).alias("dd"))
    sums = lambda z: F.aggregate(F.transform(z, lambda d: F.struct(F.exp(d).alias("e"), d.alias("d"))), zero, add)
    of_row = lambda own, x: F.struct((F.ln(x["s"]) - own).alias("loss"), (own - x["d"] / x["s"]).alias("slope"), (x["dd"] / x["s"] - F.pow(x["d"] / x["s"], 2)).alias("spread"))
    each = rows.filter(F.col(by).isin(*points)).select(by, prob.let(less, lambda z: prob.let(sums(z), lambda x: of_row(prob.at(z, F.col("label")), x))).alias("x"))
    most = -math.log(prob.CLIP)
    mean = lambda c: F.avg(F.when(F.col("x.loss") < most, F.col(f"x.{c}")).otherwise(most if c == "loss" else 0.0)).alias(c)
    return {r[by]: (r["loss"], r["slope"], r["spread"]) for r in each.groupBy(by).agg(mean("loss"), mean("slope"), mean("spread")).collect()}


def fit_temperatures(rows: DataFrame, by: str = "primitive", lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """(by, temperature, n, nll_before, nll_after, at_bound) for each group of one-hot predictions (p, label).

    The rows are read once a round: hand over a written table. A group whose loss is the same at every
    temperature keeps T = 1.
    """
    counts = {r[by]: r["n"] for r in rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).collect()}
    searches = {g: _Search(lower, upper) for g in counts}
    before = {g: x[0] for g, x in _evaluate(rows, by, dict.fromkeys(counts, 0.0)).items()} if counts and not lower <= 1 <= upper else {}
    for _ in range(ROUNDS):
        if not (points := {g: s.at for g, s in searches.items() if not s.done}):
            break
        for g, found in _evaluate(rows, by, points).items():
            before.setdefault(g, found[0])  # the first is at T = 1
            searches[g].feed(*found)
    out = []
    for g, s in searches.items():
        loss, at = s.best
        t = math.exp(at)
        out.append((g, t, counts[g], before[g], loss, min(abs(t - lower), abs(t - upper)) < 1e-4))
    return rows.sparkSession.createDataFrame(out, f"{by} string, temperature double, n bigint, nll_before double, nll_after double, at_bound boolean")


def with_verdicts(rows: DataFrame, fits: DataFrame, least: int, by: str = "primitive") -> DataFrame:
    """Fits with calibration error before and after, and a verdict; what isn't ``applied`` must not be used."""
    held = rows.join(F.broadcast(fits.select(by, "temperature")), by)  # one row for each group of the fit
    before = metrics.ece(held, [by], include_zero=True).withColumnRenamed("ece", "ece_before")
    scaled = prob.temperature_scale(F.col("p"), F.col("temperature"))
    moved = held.withColumn("top1", F.array_max(scaled)).withColumn("correct", prob.argmax(scaled) == F.col("label"))
    after = metrics.ece(moved, [by], include_zero=True).withColumnRenamed("ece", "ece_after")
    degenerate = F.col("at_bound") | (F.col("nll_after") < VANISHING)
    verdict = (
        F.when(F.col("n") < least, "insufficient_examples")
        .when(degenerate, "degenerate")
        .when(F.abs(F.ln("temperature")) >= MATERIAL, "apply")
        .when(F.col("ece_after") > STRUCTURAL, "structural_warning")
        .otherwise("neutral")
    )
    out = fits.join(before, by).join(after, by).withColumn("verdict", verdict)
    return out.withColumn("applied", ~F.col("verdict").isin("insufficient_examples", "degenerate"))


def fit_one(p: np.ndarray, label: np.ndarray, lower: float = LOWER, upper: float = UPPER) -> float:
    """Temperature of one bounded sample, by the same search in numpy; rows of ``p`` may end in zeros."""
    logs = np.where(p > 0, np.log(np.maximum(p, prob.CLIP)), -np.inf)
    logs = logs - logs.max(axis=1, keepdims=True)
    rows, most, search = np.arange(len(p)), -math.log(prob.CLIP), _Search(lower, upper)
    finite = np.where(np.isfinite(logs), logs, 0.0)
    for _ in range(ROUNDS):
        if search.done:
            break
        scale = math.exp(-search.at)
        e, z = np.exp(logs * scale), finite * scale
        s = e.sum(axis=1)
        mean, square = (e * z).sum(axis=1) / s, (e * z * z).sum(axis=1) / s
        loss = np.log(s) - logs[rows, label] * scale
        inside = loss < most
        search.feed(float(np.minimum(loss, most).mean()), float(np.where(inside, z[rows, label] - mean, 0).mean()), float(np.where(inside, square - mean**2, 0).mean()))
    return math.exp(search.best[1])


def fit_samples(drawn: DataFrame, by: list[str]) -> DataFrame:
    """(by, temperature) of many bounded samples at once: one group is one sample, whose size the sampler fixes."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        width = pdf["p"].map(len).max()
        p = np.array([np.pad(v, (0, width - len(v))) for v in pdf["p"]])
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), fit_one(p, pdf["label"].to_numpy(np.int64))]], columns=[*by, "temperature"])

    kinds = ", ".join(f"{c} {drawn.schema[c].dataType.simpleString()}" for c in by)
    return drawn.select(*by, "p", "label").groupBy(*by).applyInPandas(fit, f"{kinds}, temperature double")


#: Temperatures that one call of ``losses_at`` takes, over all groups: what a task is sent, and what it sends back.
POINTS = 1_000_000


def _losses(points: dict[str, tuple[list[str], np.ndarray]]):
    most = -math.log(prob.CLIP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {g: np.zeros(len(t)) for g, (_, t) in points.items()}
        seen = dict.fromkeys(points, 0)
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), object)
            vectors, label = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            held = np.arange(size.max(initial=1)) < size[:, None]
            logs = np.full(held.shape, -np.inf)
            logs[held] = np.log(np.maximum(vectors.flatten().to_numpy(zero_copy_only=False), prob.CLIP))
            for g in set(groups):
                own = np.flatnonzero(groups == g)
                less = np.ascontiguousarray((logs[own] - logs[own].max(axis=1, keepdims=True)).T)  # a row for each entry: sums run over whole columns
                at, z = less[label[own], np.arange(len(own))], np.empty_like(less)
                seen[g] += len(own)
                for i, t in enumerate(points[g][1]):
                    np.exp(np.divide(less, t, out=z), out=z)
                    sums[g][i] += np.minimum(np.log(z.sum(axis=0)) - at / t, most).sum()
        for g, (names, _) in points.items():
            if seen[g]:
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(sums[g]), pa.array([seen[g]] * len(names), pa.int64())], ["by", "point", "loss", "n"])

    return run


def _scorable():
    """Whether a row has a vector without gaps and a label among its entries."""
    return F.col("label").between(0, F.size("p") - 1) & F.forall("p", lambda v: v.isNotNull())


def losses_at(rows: DataFrame, by: str, points: DataFrame) -> DataFrame:
    """(by, point, loss, n): summed clipped likelihood loss of each group's rows (p, label) at each of its points (by, point, temperature).

    Rows are read once and copied for no temperature; a task adds up its own rows and sends one sum for
    each point. Rows without a group, a vector or a label among its entries are left out. More than
    ``POINTS`` temperatures are refused.
    """
    found = points.select(by, "point", "temperature").limit(POINTS + 1).collect()
    if len(found) > POINTS:
        raise ValueError(f"more than {POINTS} temperatures")
    each: dict[str, list] = {}
    for r in found:
        each.setdefault(r[by], []).append((r["point"], r["temperature"]))
    given = {g: ([n for n, _ in at], np.array([t for _, t in at])) for g, at in each.items()}
    kept = rows.filter(F.col(by).isin(*given) & _scorable()).select(by, "p", F.col("label").cast("bigint"))
    parts = kept.mapInArrow(_losses(given), "by string, point string, loss double, n bigint")
    return parts.groupBy(F.col("by").alias(by), "point").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))


def held_out_losses(rows: DataFrame, drawn: DataFrame, fits: DataFrame) -> DataFrame:
    """(workload, k, r, arm, nll): mean loss of the rows that a sample did not draw, by arm.

    ``rows`` and ``drawn`` hold (workload, p, label, serving), ``drawn`` and ``fits`` their sample (k, r),
    ``fits`` its temperatures (own, pooled). The loss of what was not drawn is that of all rows less that
    of the sample, so no row is copied for the samples that leave it out. Rows without a workload, a vector
    or a label among its entries take no part.
    """
    rows, drawn = rows.filter(_scorable()), drawn.filter(_scorable())
    key = ["workload", "k", "r"]
    own = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("temperature")) for a in ("pooled", "own")])).alias("x")
    points = fits.select(*key, own).select(*key, "x.*").withColumn("point", F.concat_ws(":", "k", "r", "arm"))
    moved = losses_at(rows, "workload", points).join(points, ["workload", "point"]).select(*key, "arm", "loss", "n")
    loss = lambda t: prob.nll_clip(prob.temperature_scale(F.col("p"), t), F.col("label"))
    fixed = {"raw": F.lit(1.0), "serving": F.col("serving")}
    sums = rows.groupBy("workload").agg(*[F.sum(loss(t)).alias(a) for a, t in fixed.items()], F.count(loss(F.lit(1.0))).alias("n"))
    still = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("loss")) for a in fixed])).alias("x")
    every = fits.select(key).join(sums, "workload").select(*key, still, "n").select(*key, "x.*", "n").unionByName(moved)
    arms = {**fixed, "pooled": F.col("pooled"), "own": F.col("own")}
    taken = drawn.join(fits, key).groupBy(*key).agg(*[F.sum(loss(t)).alias(a) for a, t in arms.items()], F.count(loss(F.lit(1.0))).alias("out"))
    less = F.element_at(F.create_map(*[x for a in arms for x in (F.lit(a), F.col(a))]), F.col("arm"))
    return every.join(taken, key).select(*key, "arm", ((F.col("loss") - less) / (F.col("n") - F.col("out"))).alias("nll"))


class Scorer:
    """What turns views into vectors: ``score(prompts, n_labels)``, each row's result independent of its batch."""

    def score(self, prompts: list[str], n_labels: list[int]) -> list[list[float]]:
        raise NotImplementedError


class PrefixScorer(Scorer):
    """A scorer that can stop after a prefix and go on from there as often as asked."""

    def begin(self, prefix: str):
        """What the scorer knows after the prefix; ``finish`` must leave it as it is."""
        raise NotImplementedError

    def finish(self, state, suffix: str, n_labels: int) -> list[float]:
        raise NotImplementedError

    def score(self, prompts: list[str], n_labels: list[int]) -> list[list[float]]:
        return [self.finish(self.begin(""), prompt, n) for prompt, n in zip(prompts, n_labels)]


class HashScorer(PrefixScorer):
    """Contract double: logits from a hash of prompt and label only. A hash of a prefix goes on over the suffix."""

    def begin(self, prefix):
        return hashlib.sha256(prefix.encode())

    def finish(self, state, suffix, n_labels):
        whole = state.copy()
        whole.update(f"{suffix}\n".encode())
        z = []
        for i in range(n_labels):
            own = whole.copy()
            own.update(str(i).encode())
            z.append(4 * int(own.hexdigest()[:8], 16) / 2**32)
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]


def score_views(views: DataFrame, scorer: Scorer, prompt_col: str = "prompt", labels_col: str = "n_labels") -> DataFrame:
    """Views with ``p``: one scorer for each Python worker, Arrow batches in and out. Equal prompts should be made distinct first."""
    from pyspark.sql import types as T

    schema = T.StructType([*views.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p=scorer.score(pdf[prompt_col].tolist(), pdf[labels_col].tolist()))

    return views.mapInPandas(run, schema)
