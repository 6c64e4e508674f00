"""Probability algebra on ``array<double>`` columns; Catalyst expressions only, no UDF.

Vectors are aligned with the question's answer keys. Lambdas get whole-array values through ``let``, so
that sums and maxima are computed once for each row and not once for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The floors of the likelihood, the prior, and the smoothed divergence.
CLIP, PRIOR_FLOOR, KL_SMOOTH = 1e-12, 1e-9, 1e-9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def indices(x: Column) -> Column:
    return F.transform(x, lambda _, i: i)


def normalise(x: Column) -> Column:
    """x / sum(x); uniform where nothing has mass."""
    return let(x, lambda v: let(total(v), lambda s: F.transform(v, lambda e: F.when(s > 0, e / s).otherwise(1.0 / F.size(v)))))


def softmax(logits: Column) -> Column:
    return normalise(let(logits, lambda z: let(F.array_max(z), lambda m: F.transform(z, lambda v: F.exp(v - m)))))


def temperature_scale(p: Column, t: Column | float) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    return softmax(F.transform(p, lambda v: F.ln(F.greatest(v, F.lit(CLIP))) / t))


def contextual(p: Column, prior: Column) -> Column:
    """Divide out a content-free prior and normalise."""
    return normalise(F.zip_with(p, prior, lambda a, b: a / F.greatest(b, F.lit(PRIOR_FLOOR))))


def argmax(p: Column) -> Column:
    """First index of the largest value."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def at(p: Column, i: Column) -> Column:
    return F.get(p, i)


def one_hot(index: Column, width: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def confidence_choice(p: Column) -> Column:
    k = F.size(p)
    return F.when(k <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), (F.array_max(normalise(p)) - 1.0 / k) / (1.0 - 1.0 / F.greatest(k, F.lit(2)))))


def confidence_score(p: Column) -> Column:
    """One minus the mean distance from the mode, relative to that of a uniform spread from the middle."""

    def spread(v):
        middle = (F.size(v) - 1) / 2
        own = let(F.array_position(v, F.array_max(v)) - 1, lambda m: total(F.transform(v, lambda e, i: e * F.abs(i - m))))
        even = total(F.transform(v, lambda _, i: F.abs(i - middle).cast("double"))) / F.size(v)
        return F.when(F.size(v) <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - own / even))

    return let(normalise(p), spread)


def confidence_entropy(p: Column) -> Column:
    h = total(F.transform(normalise(p), lambda v: F.when(v > 0, v * F.ln(v)).otherwise(0.0)))
    return F.when(F.size(p) <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 + h / F.ln(F.greatest(F.size(p), F.lit(2)).cast("double"))))


#: Registry of confidence schemes by name.
CONFIDENCE = {"choice": confidence_choice, "score": confidence_score, "entropy-v0": confidence_entropy}


def expected_score(p: Column) -> Column:
    return total(F.transform(p, lambda v, i: v * i))


def nll_clip(p: Column, label: Column) -> Column:
    return -F.ln(F.greatest(at(p, label), F.lit(CLIP)))


def nll_add(p: Column, label: Column) -> Column:
    return -F.ln(at(p, label) + F.lit(CLIP))


def brier(p: Column, t: Column) -> Column:
    """Summed over classes, not averaged."""
    return total(F.zip_with(p, t, lambda a, b: (a - b) * (a - b)))


def jensen_shannon(p: Column, q: Column) -> Column:
    part = lambda v, m: F.when(v > 0, v * F.ln(v / m)).otherwise(0.0)
    return 0.5 * total(F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2)))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * total(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def kl_smoothed(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: a * F.ln((a + KL_SMOOTH) / (b + KL_SMOOTH))))


def drift(p: Column, q: Column) -> Column:
    return F.array_max(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def cumulative(p: Column) -> Column:
    """Prefix sums, by one pass that carries the growing array."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    step = lambda a, v: F.struct((a["s"] + v).alias("s"), F.concat(a["out"], F.array(a["s"] + v)).alias("out"))
    return F.aggregate(p, start, step, lambda a: a["out"])


def ranked_probability(p: Column, t: Column) -> Column:
    return brier(cumulative(p), cumulative(t))


def cross_entropy(logits: Column, t: Column) -> Column:
    return -total(F.zip_with(softmax(logits), t, lambda a, b: F.when(b > 0, b * F.ln(F.greatest(a, F.lit(CLIP)))).otherwise(0.0)))


def mixed_target(gold: Column, soft: Column) -> Column:
    return F.zip_with(gold, soft, lambda a, b: (a + b) / 2)


def target_normalised(t: Column, k: Column, tolerance: float = 0.020000001) -> Column:
    """The vector over its sum; null where it isn't ``k`` probabilities that sum to about one."""
    fine = (F.size(t) == k) & F.forall(t, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1)) & (F.abs(total(t) - 1) <= tolerance)
    return F.when(fine, normalise(t))


def valid_vector(p: Column, tolerance: float = 1e-5) -> Column:
    return F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1)) & (F.abs(total(p) - 1) <= tolerance)


def typed_answer(kind: Column, keys: Column, p: Column) -> Column:
    """The answer of a question as one struct; members of other types are null."""
    none = lambda k: F.lit(None).cast(k)
    top = F.element_at(keys, argmax(p) + 1)
    return F.struct(
        kind.alias("type"),
        F.when(kind == "choice", top).alias("choice"),
        F.when(kind == "score", expected_score(p)).alias("score"),
        F.when(kind == "noul", at(p, F.lit(1))).alias("noul"),
        F.when(kind != "noul", p).otherwise(none("array<double>")).alias("probabilities"),
        F.when(kind == "score", keys).otherwise(none("array<string>")).alias("legend"),
        F.when(kind == "choice", confidence_choice(p)).when(kind == "score", confidence_score(p)).alias("confidence"),
    )
