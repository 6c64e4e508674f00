"""Leakage groups and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.graph import components, with_least
from assay.storage import materialize

from .pairing import crossing_keys
from .resample import seeded


def groups(edges: DataFrame) -> DataFrame:
    """(id, component): examples that share a key, directly or over others, with the smallest id as the label.

    ``edges`` is (id, key). Each key becomes a star around its smallest id, so that a key of many
    examples adds as many links as it has rows and no pairs; a key of very many is met by broadcast.
    """
    edges = materialize(edges.select("id", "key"), "keys")
    links = with_least(edges, "key", "id", "head").select("head", "id").filter("head <> id")
    found = components(links)
    ids = edges.select("id").distinct()
    return ids.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def split(edges: DataFrame, test_ids: DataFrame, development: float = 0.1, calibration: float = 0.1, seed: str = "42") -> DataFrame:
    """(id, component, split): test rows as given, training components that touch them removed, the rest cut by groups.

    Fractions are of groups, rounded half to even, at least one group each; groups are taken in seeded
    order of their label. Fails if nothing would be left to train on.
    """
    if not (0 < development < 1 and 0 < calibration < 1 and development + calibration < 1):
        raise ValueError("fractions must be positive and sum to less than one")
    members = groups(edges).join(test_ids.select("id").distinct().withColumn("is_test", F.lit(True)), "id", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))
    members = materialize(members, "members")
    touched = members.filter("is_test").select("component").distinct()
    free = members.join(touched, "component", "left_anti").select("component").distinct()
    n = free.count()
    n_dev, n_cal = max(1, round(n * development)), max(1, round(n * calibration))
    if n_dev + n_cal >= n:
        raise ValueError("not enough independent groups")
    # the first groups in seeded order: a top-n, so that the rest is never sorted in one task
    first = free.orderBy(seeded(seed, "component"), "component").limit(n_dev + n_cal)
    dev = first.orderBy(seeded(seed, "component"), "component").limit(n_dev).withColumn("part", F.lit("development"))
    held = first.join(dev, "component", "left").withColumn("part", F.coalesce("part", F.lit("calibration")))
    out = members.join(held, "component", "left").join(touched.withColumn("touched", F.lit(True)), "component", "left")
    part = F.when(F.col("is_test"), "test").when(F.col("touched"), "removed").otherwise(F.coalesce("part", F.lit("train")))
    return out.select("id", "component", part.alias("split"))


def assert_disjoint(edges: DataFrame, parts: DataFrame) -> None:
    """Fails if a key occurs in two splits; removed rows don't count."""
    held = edges.join(parts.filter("split <> 'removed'").select("id", "split"), "id")
    if bad := crossing_keys(held).limit(1).collect():
        raise ValueError(f"leakage over {bad[0]['key']}")
