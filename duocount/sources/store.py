"""Saving and loading a comparison (S07): Parquet, exact, with the spec as one JSON row."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from duocount.spec import ComparisonSpec


def save_comparison(df: DataFrame, spec: ComparisonSpec, out: str, mode: str = "overwrite") -> None:
    """Table under ``out/data`` (partitioned by the run columns when there are any), spec under ``out/spec``."""
    w = df.write.mode(mode)
    if spec.run_cols:
        w = w.partitionBy(*spec.run_cols)
    w.parquet(f"{out}/data")
    payload = json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in asdict(spec).items()})
    df.sparkSession.createDataFrame([(payload,)], "spec string").write.mode(mode).json(f"{out}/spec")


def load_comparison(spark: SparkSession, path: str):
    """``(df, spec)`` as saved; no re-inference of types (Parquet carries them)."""
    raw = json.loads(spark.read.json(f"{path}/spec").first()["spec"])
    spec = ComparisonSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
    return spark.read.parquet(f"{path}/data"), spec
