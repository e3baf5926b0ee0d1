"""Stages run one after the other, each kept as a table with a manifest, so that a run goes on where an earlier one ended."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from mnemolith.sources import tables as store

Stage = Callable[[SparkSession, DataFrame | None], DataFrame]


def fingerprint(config: dict, without: tuple[str, ...] = ("_config_path",)) -> str:
    """SHA-256 of the configuration as JSON with sorted keys; where it was read from doesn't count."""
    kept = {k: v for k, v in config.items() if k not in without}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def load_config(spark: SparkSession, path: str, required: dict[str, type]) -> dict:
    """A JSON object from any of Spark's file systems, with every required key of its kind."""
    config = json.loads(spark.read.text(path, wholetext=True).first().value)
    faults = [f"{k} is missing" if k not in config else f"{k} must be {kind.__name__}" for k, kind in required.items() if not isinstance(config.get(k), kind) or isinstance(config.get(k), bool) and kind is not bool]
    if faults:
        raise ValueError("; ".join(faults))
    return config | {"_config_path": path}


def run_stages(spark: SparkSession, root: str, stages: list[tuple[str, Stage]], config: dict) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The last stage's table, and of each stage whether it ``ran`` or was ``kept``.

    A stage is kept if its manifest is there with this configuration's fingerprint and all stages before were kept.
    The manifest is written last, so a table that was cut off is made again.
    """
    mark, df, done, kept = fingerprint(config), None, [], True
    for k, (name, stage) in enumerate(stages):
        path = f"{root}/{k}_{name}"
        try:
            kept = kept and store.read_manifest(spark, path)["fingerprint"] == mark
        except AnalysisException:  # not there
            kept = False
        if not kept:
            stage(spark, df).write.mode("overwrite").parquet(path)
            n = spark.read.parquet(path).count()
            store.write_manifest(spark, path, {"version": store.VERSION, "rows": n, "fingerprint": mark}, "overwrite")
        df = spark.read.parquet(path)
        done.append((name, "kept" if kept else "ran"))
    return df, done
