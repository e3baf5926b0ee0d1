"""Differences, resampling and warping of trajectories (key, pos, x)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def momentum(steps: DataFrame, key: str = "key") -> DataFrame:
    """x[t] - x[t - 1]; a trajectory of one step gives one zero."""
    w = Window.partitionBy(key).orderBy("pos")
    n = F.count("*").over(Window.partitionBy(key))
    d = steps.withColumns({"dx": F.col("x") - F.lag("x").over(w), "n": n})
    return d.where((F.col("pos") > 0) | (F.col("n") == 1)).select(key, F.when(F.col("n") == 1, 0).otherwise(F.col("pos") - 1).alias("pos"), F.coalesce("dx", F.lit(0.0)).alias("dx"))


def resample(steps: DataFrame, points: int, key: str = "key") -> DataFrame:
    """Linear interpolation at ``points`` places, the ends half a step inside."""
    places = steps.groupBy(key).agg(F.count("*").alias("t")).select(key, "t", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    src = F.least(F.greatest((F.col("i") + 0.5) * F.col("t") / points - 0.5, F.lit(0.0)), (F.col("t") - 1).cast("double"))
    low = F.floor(src)
    share = src - low
    # the two steps that a place lies between, each with its share; a trajectory is never gathered
    wanted = places.select(key, "i", F.explode(F.array(F.struct(low.alias("pos"), (1 - share).alias("part")), F.struct(F.least(low + 1, F.col("t") - 1).alias("pos"), share.alias("part")))).alias("w")).select(key, "i", "w.pos", "w.part")
    numbered = steps.select(key, "x", (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("long").alias("pos"))
    return wanted.join(numbered, [key, "pos"]).groupBy(key, F.col("i").alias("pos")).agg(F.sum(F.col("part") * F.col("x")).alias("x")).select(key, "pos", "x")


def dtw(pairs: DataFrame, band: int) -> DataFrame:
    """Adds ``distance``: warping cost of (left, right), arrays of vectors, with cosine cost inside a band, over the longer length.

    Pairs are rows already; each is worked on by itself, in Arrow batches.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(distance=[_dtw(np.array([*map(np.asarray, x)], float), np.array([*map(np.asarray, y)], float), band) for x, y in zip(b["left"], b["right"])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", distance double"
    return pairs.mapInPandas(each, schema)


def _dtw(x: np.ndarray, y: np.ndarray, band: int) -> float:
    ux, uy = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (x, y))
    cost = np.maximum(0, 1 - ux @ uy.T)
    n, m = cost.shape
    width = max(band, abs(n - m))
    best = np.full((n + 1, m + 1), np.inf)
    best[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - width), min(m, i + width) + 1):
            best[i, j] = cost[i - 1, j - 1] + min(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1])
    return float(best[n, m] / max(n, m))


def running_offset(rows: DataFrame, key: str, order: str, length: str) -> DataFrame:
    """Where each row's span starts if the rows of a key are laid end to end."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))
