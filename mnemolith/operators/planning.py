"""Blocks of sequences, retrieval points and their candidate blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mechanical_blocks(sequences: DataFrame, size: int) -> DataFrame:
    """Blocks of exactly ``size`` tokens of (sequence_id, n_tokens); the tail is dropped."""
    n = F.floor(F.col("n_tokens") / size).cast("int")
    return sequences.where(n > 0).select("sequence_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("block_index")).select(
        "sequence_id", "block_index",
        F.format_string("%s:%07d", F.col("sequence_id"), F.col("block_index")).alias("block_id"),
        (F.col("block_index") * size).cast("long").alias("start_position"),
        ((F.col("block_index") + 1) * size).cast("long").alias("end_position"),
    )


def retrieval_plans(sequences: DataFrame, *, local: int = 256, block: int = 32, horizon: int = 16, interval: int = 32, least: int = 1, points: Column | None = None) -> DataFrame:
    """Retrieval points of (sequence_id, n_tokens): every ``interval`` tokens, or those of the array ``points``.

    A point t sees the local tokens (t - local, t] and predicts (t, t + horizon]; one more
    token must follow. ``least`` blocks must lie before the local ones.
    """
    first, last = local + least * block - 1, F.col("n_tokens") - horizon - 2
    at = F.explode(points) if points is not None else F.explode(F.when(last >= first, F.sequence(F.lit(first).cast("long"), last.cast("long"), F.lit(interval).cast("long"))))
    plans = sequences.select("sequence_id", "n_tokens", at.alias("retrieval_position")).withColumn("retrieval_position", F.col("retrieval_position").cast("long"))
    start = F.greatest(F.lit(0).cast("long"), F.col("retrieval_position") + 1 - local)
    n = F.floor(start / block).cast("int")
    return plans.select(
        F.format_string("%s:%09d", F.col("sequence_id"), F.col("retrieval_position")).alias("sample_id"), "sequence_id", "retrieval_position",
        (F.col("retrieval_position") + 1).alias("first_future_position"), F.lit(horizon).alias("horizon"),
        start.alias("local_start"), (F.col("retrieval_position") + 1).alias("local_end"), n.alias("n_candidates"),
    ).where(F.col("n_candidates") >= least)


def plan_candidates(plans: DataFrame, *, block: int = 32, most: int | None = None) -> DataFrame:
    """The blocks that end before each plan's local tokens, the last ``most`` of them; arithmetic, no join."""
    first = F.lit(0) if most is None else F.greatest(F.lit(0), F.col("n_candidates") - most)
    return plans.where("n_candidates > 0").select("sample_id", "sequence_id", "n_candidates", first.alias("f")).select(
        "sample_id", "sequence_id", F.explode(F.sequence(F.col("f"), F.col("n_candidates") - 1)).alias("block_index"), "f",
    ).select(
        "sample_id", (F.col("block_index") - F.col("f")).alias("cand_index"), F.format_string("%s:%07d", F.col("sequence_id"), F.col("block_index")).alias("block_id"),
        (F.col("block_index") * block).cast("long").alias("start_position"), ((F.col("block_index") + 1) * block).cast("long").alias("end_position"),
    )


def expected_samples(n_tokens: int, sequences: int, *, local: int, block: int, least: int, horizon: int, interval: int) -> int:
    first, last = local + least * block - 1, n_tokens - horizon - 2
    return ((last - first) // interval + 1) * sequences if last >= first else 0


def overlapping_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that start before the one before them, by start, ends."""
    from pyspark.sql import Window

    w = Window.partitionBy("sequence_id").orderBy("start_position", "end_position")
    return blocks.withColumn("before_end", F.lag("end_position").over(w)).where("start_position < before_end")


def interval_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points in [start, end) of the same key, for ranges of any lengths: an equi-join on key and cell, then the exact test.

    A range goes to each cell of ``width`` that it touches, a point to its own, so no pair is met twice.
    """
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("__cell", F.floor(F.col(at) / width)).join(cells, [key, "__cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__cell")


def answer_positions(prompt: Column, full: Column) -> Column:
    """An array of (family, position, place): the prompt's last token (place -1), and the answer's tokens."""
    answer = F.when(full > prompt, F.transform(F.sequence(F.lit(0), full - prompt - 1), lambda i: F.struct(F.lit("answer").alias("family"), (prompt + i).alias("position"), i.alias("place"))))
    last = F.array(F.struct(F.lit("final_prompt").alias("family"), (prompt - 1).alias("position"), F.lit(-1).alias("place")))
    return F.concat(last, F.coalesce(answer, F.slice(last, 1, 0)))
