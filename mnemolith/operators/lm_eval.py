"""Streams of tokens cut into sequential windows, and their perplexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_offsets(docs: DataFrame, order: str, length: Column) -> DataFrame:
    """Adds ``offset``: the sum of ``length`` over all rows before, by ``order``.

    Two phases: rows are dealt by range of their order, sums of the ranges (one row each)
    give each range's start, and only within a range is there a window.
    """
    from mnemolith.session import cut

    ranged = cut(docs.withColumn("__n", length).repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum("__n").alias("__s"))
    starts = sums.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    w = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(starts), "__part").withColumn("offset", F.col("__start") + F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n", "__part", "__start")


def window_counts(total: DataFrame, streams: int, size: int) -> DataFrame:
    """(stream, window_index, tokens) of a corpus of so many tokens (the one value of a table), each of which has a next one in its stream; arithmetic, no token is made."""
    length = F.floor(F.col("n") / streams) - 1
    grid = total.toDF("n").select(length.alias("length"), F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("stream")).where("length > 0")
    windows_ = grid.select("stream", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("w"))
    return windows_.select("stream", F.col("w").cast("int").alias("window_index"), F.least(F.lit(size).cast("long"), F.col("length") - F.col("w") * size).alias("tokens"))


def windows(tokens: DataFrame, size: int) -> DataFrame:
    """Each token with its target (the next of its stream), window and place in it; the last window may be shorter."""
    w = Window.partitionBy("stream").orderBy("pos")
    return tokens.withColumn("target", F.lead("token_id").over(w)).where(F.col("target").isNotNull()).withColumns({"window_index": F.floor(F.col("pos") / size).cast("int"), "place": (F.col("pos") % size).cast("int")})


def window_nll(rows: DataFrame, size: int, pos: str = "pos", nll: str = "nll", key: str = "stream") -> DataFrame:
    return rows.groupBy(key, F.floor(F.col(pos) / size).cast("int").alias("window_index")).agg(F.count("*").alias("tokens"), F.sum(nll).alias("nll"))


def perplexity(window_rows: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, mean negative log likelihood and its exponential (capped at exp(700))."""
    mean = F.sum("nll") / F.sum("tokens")
    return window_rows.groupBy(*by).agg(F.sum("tokens").alias("tokens"), mean.alias("nll"), F.exp(F.least(F.lit(700.0), mean)).alias("perplexity"))


def first_window_guard(rows: DataFrame, tolerance: float = 1e-6, base: str = "base") -> DataFrame:
    """(method, window_size, difference, ok): the first window's loss against the base method's, relative to it."""
    first = rows.where("window_index = 0").groupBy("method", "window_size").agg(F.sum("nll").alias("nll"))
    b = first.where(F.col("method") == base).select("window_size", F.col("nll").alias("base_nll"))
    d = F.abs(F.col("nll") - F.col("base_nll")) / F.greatest(F.abs(F.col("base_nll")), F.lit(1e-12))
    return first.where(F.col("method") != base).join(b, "window_size").select("method", "window_size", d.alias("difference"), (d <= tolerance).alias("ok"))


def position_offset(method: Column, policy: Column, window_index: Column, stream_position: Column, size: Column) -> Column:
    """Position of a window's first token: 0 for the base method, the first window or the policy window_reset, one window for cache_relative, the stream's own for continuous."""
    reset = (method == "base") | (policy == "window_reset") | (window_index == 0)
    unknown = F.raise_error(F.concat(F.lit("unknown position policy "), policy)).cast("long")
    return F.when(reset, F.lit(0)).when(policy == "cache_relative", size).when(policy == "continuous", stream_position).otherwise(unknown).cast("long")


def prediction_metrics(logits: DataFrame) -> DataFrame:
    """Per condition over (condition, pos, token, logit, full_logit, target): next-token loss, KL from full context, agreement, accuracy."""
    from mnemolith.functions.vector import logsumexp

    by = ("condition", "pos")
    w = Window.partitionBy(*by)
    rows = logits.withColumns({"lp": F.col("logit") - logsumexp(F.col("logit"), *by), "lf": F.col("full_logit") - logsumexp(F.col("full_logit"), *by)})
    rows = rows.withColumns({"top": F.row_number().over(w.orderBy(F.desc("logit"), "token")), "full_top": F.row_number().over(w.orderBy(F.desc("full_logit"), "token"))})
    own = F.col("token") == F.col("target")
    each = rows.groupBy(*by).agg(
        F.sum(F.when(own, -F.col("lp"))).alias("nll"), F.sum(F.exp("lf") * (F.col("lf") - F.col("lp"))).alias("kl"),
        F.max(F.when((F.col("top") == 1) & (F.col("full_top") == 1), 1.0).otherwise(0.0)).alias("agree"), F.max(F.when(own & (F.col("top") == 1), 1.0).otherwise(0.0)).alias("right"),
    )
    return each.groupBy("condition").agg(F.avg("nll").alias("next_token_nll"), F.greatest(F.lit(0.0), F.avg("kl")).alias("kl_from_full_context"), F.avg("agree").alias("full_argmax_agreement"), F.avg("right").alias("teacher_forced_token_accuracy"))


def state_differences(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Over two tables (by..., token, dim, x): largest and mean absolute difference, RMS, relative RMSE, least and mean token cosine."""
    both = a.join(b.withColumnRenamed("x", "y"), [*by, "token", "dim"])
    d = F.col("y") - F.col("x")
    token = both.groupBy(*by, "token").agg(F.max(F.abs(d)).alias("m"), F.sum(F.abs(d)).alias("s"), F.sum(d * d).alias("dd"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.count("*").alias("n"))
    cos = F.col("xy") / F.greatest(F.sqrt(F.col("xx") * F.col("yy")), F.lit(1e-12))
    return token.groupBy(*by).agg(F.max("m").alias("max_abs"), (F.sum("s") / F.sum("n")).alias("mean_abs"), F.sqrt(F.sum("dd") / F.sum("n")).alias("rms"), F.sqrt(F.sum("dd") / F.greatest(F.sum("xx"), F.lit(1e-24))).alias("relative_rmse"), F.min(cos).alias("min_cosine"), F.avg(cos).alias("mean_cosine"))
