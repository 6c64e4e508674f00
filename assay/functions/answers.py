"""Answers as ordered vectors: what a teacher or a local scorer says, by option name, in the question's own order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import prob

#: How far a distribution's sum, and a score from its expectation, may be off.
TOLERANCE = 1e-5


def ordered(kind: Column, keys: Column, noul: Column, held: Column) -> Column:
    """The vector in the order of ``keys``: (1 - yes, yes) of a yes/no answer, else the named probabilities; null where a name is missing."""
    named = F.transform(keys, lambda k: F.try_element_at(held, k).cast("double"))
    vector = F.when(kind == "noul", F.array(1.0 - noul, noul)).otherwise(named)
    return F.when(F.forall(vector, lambda v: v.isNotNull()), vector)


def problem(kind: Column, answered: Column, keys: Column, noul: Column, held: Column, choice: Column, score: Column) -> Column:
    """Why a local answer contradicts itself; null if it doesn't. The first reason in this order is given."""
    vector = ordered(kind, keys, noul, held)
    same_names = F.size(F.array_except(F.map_keys(held), keys)) + F.size(F.array_except(keys, F.map_keys(held))) == 0
    chosen = F.get(vector, (F.array_position(keys, choice) - 1).cast("int"))
    return (
        F.when(~F.coalesce(answered == kind, F.lit(False)), "type mismatch")
        .when((kind != "noul") & ~F.coalesce(same_names, F.lit(False)), "label mismatch")
        .when(F.isnull(vector) | ~F.coalesce(prob.valid_vector(vector, TOLERANCE), F.lit(False)), "not a distribution")
        .when((kind == "choice") & ~F.coalesce(chosen == F.array_max(vector), F.lit(False)), "choice is not the most likely")
        .when((kind == "score") & ~F.coalesce(F.abs(score - prob.expected_score(prob.normalise(vector))) <= TOLERANCE, F.lit(False)), "score is not expected")
    )


def without_prefix(name: Column, prefix: str) -> Column:
    """A source's name without a leading ``prefix``."""
    return F.when(name.startswith(prefix), F.substring(name, F.lit(len(prefix) + 1), F.length(name))).otherwise(name)


def is_paired(name: Column) -> Column:
    """Whether an id is one side of a pair: it ends in ``-a`` or ``-b``."""
    return name.endswith("-a") | name.endswith("-b")


def titled(title: Column, content: Column) -> Column:
    """Title and content, each stripped, on lines of their own; an empty one leaves no line. Nulls count as empty."""
    strip = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\u000b\f"))
    return strip(F.concat(strip(title), F.lit("\n"), strip(content)))
