"""Sequential evaluation of a stream in windows, beside a memory that a window reads before it is written.

Rows: (stream, win, seq, ...). What a window reads was written in an earlier
window, never in its own or a later one; ``leaks`` finds reads that break this.
Losses: (method, stream, win, tokens, nll); perplexities follow from running
sums over windows in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Beyond this a mean loss counts as this, so that the perplexity stays finite.
MOST = 700.0


def recalled(rows: DataFrame, key: str, value: str, into: str = "recalled") -> DataFrame:
    """Adds what the last row of the same stream and key held in an earlier window; null if there was none.

    The frame goes up to the window before by its number, so no row of the own window is in it, whatever the order of rows.
    """
    w = Window.partitionBy("stream", key).orderBy("win").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.max(F.struct("win", "seq", value)).over(w)[value])


def leaks(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(stream, win, seq, source, written): results of reads (stream, win, seq, results) that were written (stream, win, source) no earlier than the read's window."""
    each = reads.select("stream", "win", "seq", F.explode("results").alias("source"))
    first = writes.groupBy("stream", "source").agg(F.min("win").alias("written"))
    return each.join(first, ["stream", "source"]).where("written >= win").select("stream", "win", "seq", "source", "written")


def window_losses(rows: DataFrame, methods: dict[str, Column]) -> DataFrame:
    """(method, stream, win, tokens, nll): sums of each method's loss over a window's rows; a row without a loss isn't counted."""
    each = rows.select("stream", "win", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), c.cast("double").alias("loss")) for m, c in methods.items()])).alias("m")).select("stream", "win", "m.method", "m.loss")
    return each.where(F.col("loss").isNotNull()).groupBy("method", "stream", "win").agg(F.count("*").alias("tokens"), F.sum("loss").alias("nll"))


def perplexities(losses: DataFrame) -> DataFrame:
    """Adds each window's perplexity and that of the stream so far."""
    w = Window.partitionBy("method", "stream").orderBy("win").rowsBetween(Window.unboundedPreceding, 0)
    ppl = lambda nll, n: F.exp(F.least(F.lit(MOST), nll / n))
    return losses.withColumns({"perplexity": ppl(F.col("nll"), F.col("tokens")), "so_far": ppl(F.sum("nll").over(w), F.sum("tokens").over(w))})


def comparison(losses: DataFrame, base: str) -> DataFrame:
    """(method, tokens, perplexity, gain, windows_won): all windows of a method, its mean loss below that of ``base``, and the share of windows where it is below."""
    b = losses.where(F.col("method") == base).select("stream", "win", (F.col("nll") / F.col("tokens")).alias("base_loss"))
    both = losses.join(b, ["stream", "win"]).withColumn("won", (F.col("nll") / F.col("tokens") < F.col("base_loss")).cast("double"))
    total = both.groupBy("method").agg(F.sum("tokens").alias("tokens"), F.sum("nll").alias("nll"), F.sum(F.col("base_loss") * F.col("tokens")).alias("b"), F.avg("won").alias("windows_won"))
    return total.select("method", "tokens", F.exp(F.least(F.lit(MOST), F.col("nll") / F.col("tokens"))).alias("perplexity"), ((F.col("b") - F.col("nll")) / F.col("tokens")).alias("gain"), "windows_won")


def assembled(plans: DataFrame, queries: DataFrame, blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each plan (sample_id, cand_index, block_id): the query's summary and, in the candidates' order, block ids, summaries and target shares.

    queries: (sample_id, query); blocks: (block_id, summary), shared by samples; targets: (sample_id, cand_index, mass). A candidate
    without a summary or a share, a sample without a query, and a share that belongs to no candidate are errors that name the sample.
    """
    said = lambda what: F.raise_error(F.concat(F.lit(f"no {what} for "), F.col("sample_id").cast("string"), F.lit(":"), F.coalesce(F.col("cand_index").cast("string"), F.lit("-"))))
    each = plans.join(blocks, "block_id", "left").join(targets.withColumn("__t", F.lit(True)), ["sample_id", "cand_index"], "full")
    each = each.withColumn("__ok", F.when(F.col("block_id").isNull(), said("candidate").cast("boolean")).when(F.col("summary").isNull(), said("summary").cast("boolean")).when(F.col("__t").isNull(), said("target").cast("boolean")).otherwise(True)).where("__ok")
    # a sample's own candidates, a bounded few
    whole = each.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("cand_index", "block_id", "summary", "mass"))).alias("c"))
    whole = whole.join(queries, "sample_id", "left").withColumn("cand_index", F.lit(None).cast("int"))
    part = lambda f: F.transform("c", lambda x: x[f])
    query = F.when(F.col("query").isNull(), said("query").cast("array<double>")).otherwise(F.col("query"))
    return whole.select("sample_id", query.alias("query"), part("block_id").alias("block_ids"), part("summary").alias("summaries"), part("mass").alias("masses"))
