"""Calibration artifacts: small JSON files, written once, pinned to their configuration by a digest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from .sinks import exists, write_text

FORMAT, METHOD, WORKLOAD_METHOD = 1, "per-primitive-temperature-v1", "per-workload-temperature-v1"


def digest(artifact: dict) -> str:
    """SHA-256 of the artifact with sorted keys, without its own digest."""
    held = {k: v for k, v in artifact.items() if k != "sha256"}
    return hashlib.sha256(json.dumps(held, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def identity(config: dict) -> str:
    """Sixteen digits that name a serving configuration."""
    return hashlib.sha256(json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def build(fits: DataFrame, config: dict, workload: str | None = None) -> dict:
    """The artifact of fits that may be used: one row for each primitive, of which there are few; more than 64 rows are refused."""
    held = fits.limit(65).collect()
    if len(held) > 64 or len({r["primitive"] for r in held}) < len(held):
        raise ValueError("not one fit for each primitive")
    rows = {r["primitive"]: {"temperature": r["temperature"], "n": r["n"], "nll_before": r["nll_before"], "nll_after": r["nll_after"], "at_bound": r["at_bound"]} for r in held}
    if not rows:
        raise ValueError("no usable fit")
    out = {"format_version": FORMAT, "method": WORKLOAD_METHOD if workload else METHOD, "prediction_config": config, "fits": rows}
    out |= {"workload": workload} if workload else {}
    return out | {"sha256": digest(out)}


def save(spark: SparkSession, artifact: dict, path: str) -> None:
    """Exclusive create: fails if the file exists."""
    if exists(spark, path):
        raise FileExistsError(path)
    write_text(spark, path, json.dumps(artifact, sort_keys=True, indent=1))


def load(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """(workload, primitive, temperature); fails on another format, a changed file or another configuration."""
    artifact = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if artifact.get("format_version") != FORMAT or artifact.get("method") not in (METHOD, WORKLOAD_METHOD):
        raise ValueError(f"{path}: unknown format")
    if artifact.get("sha256") != digest(artifact):
        raise ValueError(f"{path}: digest does not match")
    if artifact.get("prediction_config") != config:
        raise ValueError(f"{path}: made under another configuration")
    rows = [(artifact.get("workload"), p, float(f["temperature"])) for p, f in artifact["fits"].items()]
    return spark.createDataFrame(rows, "workload string, primitive string, temperature double")


class Registry:
    """Workload name to artifact, bounded and fail-closed."""

    def __init__(self, most: int = 64):
        self.most, self.held = most, {}

    def register(self, artifact: dict) -> None:
        import re

        name = artifact.get("workload")
        if not isinstance(name, str) or not re.fullmatch(r"[\w.:-]{1,64}", name):
            raise ValueError("bad workload name")
        if artifact.get("sha256") != digest(artifact):
            raise ValueError("digest does not match")
        if name not in self.held and len(self.held) >= self.most:
            raise ValueError("registry is full")
        self.held[name] = artifact

    def __getitem__(self, name: str) -> dict:
        if name not in self.held:
            raise KeyError(f"unknown workload {name!r}")
        return self.held[name]
