"""Similarity reports over vectors (id, vector, label).

Means over all pairs of cosine similarities come from sums of unit vectors
(the sum over pairs of u.v is half of |sum u|^2 less the sum of |u|^2), so no
pair is made. Reports that need neighbours take a stated query set against all
rows, in blocks: a block of queries is a matrix in each task, each task keeps
its best few, and those meet in one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions.vector import centred, unit
from mnemolith.session import bounded_batches, cut

#: Rows of a block.
BLOCK = 2048


def pair_means(rows: DataFrame, by: list[str] | None = None, centre: bool = False) -> DataFrame:
    """Mean cosine over pairs of different rows with the same and with different labels, and their margin."""
    by = by or []
    v = centred(F.col("vector")) if centre else F.col("vector")
    parts = rows.select(*by, "label", F.posexplode(unit(v)).alias("dim", "x"))
    per_label = parts.groupBy(*by, "label", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    per_dim = per_label.groupBy(*by, "dim").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") - F.col("q")).alias("same"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same_n"), F.sum("n").alias("n"))
    total = per_dim.groupBy(*by).agg((F.sum("same") / 2).alias("same"), (F.sum(F.col("s") * F.col("s") - F.col("q")) / 2).alias("all"), (F.max("same_n") / 2).alias("same_n"), (F.max(F.col("n") * (F.col("n") - 1)) / 2).alias("all_n"))
    mean = lambda s, n: F.when(n > 0, s / n).otherwise(F.lit(0.0))
    return total.select(*by, F.col("same_n").cast("long").alias("same_pairs"), (F.col("all_n") - F.col("same_n")).cast("long").alias("different_pairs"), mean(F.col("same"), F.col("same_n")).alias("same_mean"), mean(F.col("all") - F.col("same"), F.col("all_n") - F.col("same_n")).alias("different_mean")).withColumn("margin", F.col("same_mean") - F.col("different_mean"))


def zscored(rows: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Vectors with each dimension less its mean, over its sample deviation (``floor`` at least), over all rows."""
    stats = rows.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.greatest(F.stddev_samp("x"), F.lit(floor)).alias("s"))
    table = F.broadcast(stats.agg(F.sort_array(F.collect_list(F.struct("dim", "m", "s"))).alias("__stats")))  # one row of the vector's length
    return rows.crossJoin(table).withColumn("vector", F.zip_with("vector", "__stats", lambda x, t: (x.cast("double") - t["m"]) / t["s"])).drop("__stats")


def _blocks(rows: DataFrame, name: str, size: int = BLOCK) -> DataFrame:
    """Rows (id, vector, label) in blocks: ids, labels and a matrix, each as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= size:
                yield block(held)
                held = []
        if held and sum(h.num_rows for h in held):
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        parts = [t["id"].to_numpy().astype("<i8"), t["label"].to_numpy().astype("<i8"), np.stack(t["vector"].to_numpy()).astype("<f8")]
        return pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in parts], names=[f"{name}_{c}" for c in ("ids", "labels", "matrix")])

    bounded_batches(rows.sparkSession)
    # a row without an id, a label or a vector takes no part
    sound = rows.select("id", F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label")).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    return sound.mapInArrow(pack, ", ".join(f"{name}_{c} binary" for c in ("ids", "labels", "matrix")))


def _met(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Each block of queries beside each block of rows. Blocks are packed and written once; rows' blocks go to the queries' by their numbers."""
    q = cut(_blocks(queries, "q").withColumn("block", F.monotonically_increasing_id()))
    numbers = q.agg(F.sort_array(F.collect_list("block")).alias("to"))  # one number for each BLOCK queries
    to = numbers.first().to
    r = cut(_blocks(rows, "r"))
    return r.withColumn("block", F.explode(F.array(*[F.lit(n).cast("long") for n in to]) if to else F.array().cast("array<bigint>"))).join(q, "block").drop("block")


def _distances(row: dict, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, query labels, ids, labels, scores where larger is nearer) of a pair of blocks; a query's own row is -inf."""
    qi, ql, ri, rl = (np.frombuffer(row[c], "<i8") for c in ("q_ids", "q_labels", "r_ids", "r_labels"))
    q, x = (np.frombuffer(row[f"{c}_matrix"], "<f8").reshape(len(n), -1) for c, n in (("q", qi), ("r", ri)))
    if metric == "cosine":
        q, x = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (q, x))
        s = q @ x.T
    else:
        s = -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T))
    s = np.round(s, 12)
    s[qi[:, None] == ri[None]] = -np.inf
    return qi, ql, ri, rl, s


def neighbours(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", higher_first: bool = True) -> DataFrame:
    """(query_id, query_label, id, label, score, rank) of the ``k`` best rows for each query, without the query itself.

    cosine: largest first; euclid: smallest first. Ties: the larger id first, or the smaller.
    Blocks of queries meet blocks of rows; of each pair of blocks the best ``k`` go on.
    """
    sign = 1 if higher_first else -1

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                qi, ql, ri, rl, s = _distances(row, metric)
                n = min(k, s.shape[1])
                order = np.lexsort((np.broadcast_to(-sign * ri, s.shape), -s), axis=1)[:, :n]
                got = [np.repeat(qi, n), np.repeat(ql, n), ri[order].ravel(), rl[order].ravel(), np.take_along_axis(s, order, 1).ravel()]
                some = np.isfinite(got[4])
                yield pa.record_batch([pa.array(c[some]) for c in got], names=["query_id", "query_label", "id", "label", "score"])

    pairs = _met(queries, rows)
    found = pairs.mapInArrow(best, "query_id long, query_label long, id long, label long, score double")
    tie = F.desc("id") if higher_first else F.asc("id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), tie))).where(F.col("rank") <= k)
    return ranked if metric == "cosine" else ranked.withColumn("score", -F.col("score"))


def distance_means(rows: DataFrame, queries: DataFrame, metric: str = "cosine") -> DataFrame:
    """One row: pairs and mean score of queries with rows of the same and of other labels, a query's own row apart; sums of each pair of blocks meet in one aggregation."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, ql, _, rl, s = _distances(row, metric)
                there, same = np.isfinite(s), ql[:, None] == rl[None]
                parts = [(there & w).sum() for w in (same, ~same)] + [s[there & w].sum() for w in (same, ~same)]
                yield pa.record_batch([pa.array([float(x)]) for x in parts], names=["ns", "no", "ss", "so"])

    every = _met(queries, rows).mapInArrow(sums, "ns double, no double, ss double, so double")
    total = every.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("ns", "no", "ss", "so")])
    sign = 1 if metric == "cosine" else -1
    mean = lambda s, n: F.when(F.col(n) > 0, sign * F.col(s) / F.col(n)).otherwise(F.lit(0.0))
    return total.select(F.col("ns").cast("long").alias("same_pairs"), F.col("no").cast("long").alias("other_pairs"), mean("ss", "ns").alias("same_mean"), mean("so", "no").alias("other_mean"))


def cross_means(queries: DataFrame, refs: DataFrame, *keys: str) -> DataFrame:
    """For each key: (key, pairs, total) of cosines of queries with references that have the same key; no key: all pairs.

    The sum over pairs of u.v is the dot product of the two sums, so no pair is made.
    """
    outs = []
    for key in (None, *keys):
        by = [key] if key else []
        sums = [r.select(*by, F.posexplode(unit(F.col("vector"))).alias("dim", "x")).groupBy(*by, "dim").agg(F.sum("x").alias(c), F.count("*").alias(f"n{c}")) for r, c in ((queries, "a"), (refs, "b"))]
        both = sums[0].join(sums[1], [*by, "dim"])
        pairs = F.sum(F.when(F.col("dim") == 0, F.col("na") * F.col("nb")).otherwise(0))
        outs.append(both.agg(F.lit(key or "all").alias("key"), F.coalesce(pairs, F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("total")))
    every = outs[0]
    for o in outs[1:]:
        every = every.unionByName(o)
    return every


def conflict_rate(found: DataFrame) -> DataFrame:
    """One row: of queries in conflict (query_conflict), how many have a first neighbour of their entity but of another label."""
    first = found.where("rank = 1 AND query_conflict")
    wrong = (F.col("entity") == F.col("query_entity")) & (F.col("label") != F.col("query_label"))
    return first.agg(F.count("*").alias("conflict_queries"), F.coalesce(F.avg(F.when(wrong, 1.0).otherwise(0.0)), F.lit(0.0)).alias("conflict_false_positive_rate"))


def retrieval_report(found: DataFrame, k: int) -> DataFrame:
    """One row: queries, top-1, recall at k, MRR within k."""
    hit = F.col("label") == F.col("query_label")
    each = found.groupBy("query_id").agg(F.max(F.when(hit & (F.col("rank") == 1), 1.0).otherwise(0.0)).alias("top1"), F.max(F.when(hit & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias("hit"), F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"))
    return each.agg(F.count("*").alias("queries"), F.coalesce(F.avg("top1"), F.lit(0.0)).alias("top1"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"))


def confusion(found: DataFrame) -> DataFrame:
    """How often each label's queries have each label first."""
    return found.where("rank = 1").groupBy("query_label", "label").agg(F.count("*").alias("n"))


def best_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key that is first by ``order``; ties must be ordered too."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def recommendation(top1: Column, conflict: Column) -> Column:
    """What a report's recall and conflict rate say."""
    return F.when((top1 >= 0.8) & (conflict <= 0.1), "go").when(top1 >= 0.6, "promising").when(top1 >= 0.4, "weak").otherwise("stop")


def verdict(recall: Column, conflict: Column, canonical_margin: Column) -> Column:
    """The advice on factual recall; its four texts and bounds are fixed values."""
    return (
        F.when((recall >= 0.80) & (conflict <= 0.10), "viable").when((canonical_margin > 0) & (recall >= 0.60), "viable only with canonical protocol")
        .when(recall >= 0.40, "viable only for procedural/task memory").otherwise("not viable for factual recall")
    )
