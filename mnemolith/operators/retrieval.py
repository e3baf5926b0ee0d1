"""Block selection policies, sweeps over budgets, and comparisons of their results.

Candidates: (sample_id, cand_index, start_position, end_position, score, mass).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions.hashing import seeded_order
from mnemolith.functions.vector import entropy_term, normalised, softmax
from mnemolith.session import cut

#: Groups that a task adds up before it sends them, and resamples of a row that it sends.
HELD, PIECE = 1024, 250
#: Rows that a task draws resamples of: at most, and at least as long as there are cores left.
MOST, LEAST = 4096, 64


def policy_order(policy: str, seed: int = 0) -> list[Column]:
    """How a policy orders a sample's candidates."""
    return {
        "learned": [F.desc("score"), F.asc("cand_index")],
        "oracle": [F.desc("mass"), F.asc("cand_index")],
        "recent": [F.desc("end_position"), F.asc("cand_index")],
        "oldest": [F.asc("start_position"), F.asc("cand_index")],
        "random": [seeded_order(F.concat_ws(":", F.col("sample_id").cast("string"), F.col("cand_index").cast("string")), seed).asc()],
    }[policy]


def select_top(candidates: DataFrame, policy: str, budget: int, seed: int = 0) -> DataFrame:
    """The first ``budget`` candidates of each sample by the policy, with their rank."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(*policy_order(policy, seed)))).where(F.col("rank") <= budget)


def select_threshold(candidates: DataFrame, budget: int, least: float) -> DataFrame:
    """Of the first ``budget`` by score, those whose softmax over all candidates is ``least`` or more."""
    return select_top(candidates.withColumn("p", softmax(F.col("score"), "sample_id")), "learned", budget).where(F.col("p") >= least)


def decision_entropy(candidates: DataFrame) -> DataFrame:
    """(sample_id, n, entropy, normalised_entropy) of the scores' softmax."""
    p = candidates.withColumn("p", softmax(F.col("score"), "sample_id"))
    return p.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum(entropy_term(F.col("p"))).alias("entropy")).withColumn("normalised_entropy", normalised(F.col("entropy"), F.col("n")))


def sweep(candidates: DataFrame, budgets: list[int], policies: tuple[str, ...] = ("learned", "oracle", "recent", "oldest", "random"), seed: int = 0) -> DataFrame:
    """(sample_id, policy, budget, covered): the share of mass that each policy covers at each budget.

    One shuffle by sample; every policy ranks there, and one aggregation makes all budgets of all policies.
    """
    ranked = candidates.withColumns({f"__{p}": F.row_number().over(Window.partitionBy("sample_id").orderBy(*policy_order(p, seed))) for p in policies})
    cells = [(p, b) for p in policies for b in budgets]
    wide = ranked.groupBy("sample_id").agg(*[F.coalesce(F.sum(F.when(F.col(f"__{p}") <= b, F.col("mass"))), F.lit(0.0)).alias(f"{p}_{b}") for p, b in cells])
    stack = f"stack({len(cells)}, " + ", ".join(f"'{p}', {b}, `{p}_{b}`" for p, b in cells) + ") AS (policy, budget, covered)"
    return wide.selectExpr("sample_id", stack)


def mean_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def finite_means(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, mean) over finite values only."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return rows.where(finite).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def differences(rows: DataFrame, baseline: str = "policy", learned: str = "learned", value: str = "covered") -> DataFrame:
    """(sample_id, budget, baseline, d): the learned policy's value less each other one's, without a self join."""
    wide = rows.groupBy("sample_id", "budget").agg(F.max(F.when(F.col(baseline) == learned, F.col(value))).alias("own"), F.collect_list(F.when(F.col(baseline) != learned, F.struct(F.col(baseline).alias("baseline"), F.col(value).alias("theirs")))).alias("rest"))
    return wide.select("sample_id", "budget", F.explode("rest").alias("r"), "own").select("sample_id", "budget", F.col("r.baseline").alias("baseline"), (F.col("own") - F.col("r.theirs")).alias("d"))


def paired(rows: DataFrame, baseline: str = "policy", learned: str = "learned", value: str = "covered", higher: bool = True) -> DataFrame:
    """For each budget and other policy: mean difference to the learned one over samples, win and tie rates."""
    each = differences(rows, baseline, learned, value)
    won = F.col("d") > 0 if higher else F.col("d") < 0
    return each.groupBy("budget", "baseline").agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.avg(F.when(won, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(F.when(F.col("d") == 0, 1.0).otherwise(0.0)).alias("tie_rate"))


def bootstrap(rows: DataFrame, by: list[str], key: list[str], value: str, iterations: int = 2000, seed: int = 0) -> DataFrame:
    """95 % percentile interval of each group's mean: (by..., low, high), the sorted means at int(0.025 n) and min(n - 1, int(0.975 n)).

    Poisson resampling: in each resample a row counts as often as a Poisson(1) draw says, which depends
    on the seed, the row's ``key`` (distinct in its group) and the resample alone. Sums of all resamples
    meet where the rows are, so no group is gathered.
    """
    bounds = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(9)])
    kinds = dict(rows.dtypes)

    ends = [str(i).encode() for i in range(iterations)]

    def digests(start: str) -> Iterator[bytes]:
        begun = hashlib.md5(start.encode())
        for end in ends:
            h = begun.copy()
            h.update(end)
            yield h.digest()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the task's sums of each group; a row's draws are worked out and added up at once
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for b in batches:
            types = [f.type for f in b.schema][: len(by)]
            for *group, name, x in zip(*(c.to_pylist() for c in b.columns)):
                drawn = (np.frombuffer(b"".join(digests(f"{seed}:{name}:")), ">u8").reshape(-1, 2)[:, 0] >> np.uint64(16)) / float(1 << 48)
                times = np.searchsorted(bounds, drawn, side="right").astype(float)
                at = held.setdefault(tuple(group), np.zeros((2, iterations)))
                at[0] += times
                at[1] += times * (0.0 if x is None else x)
            if len(held) > HELD:
                yield blocks(held, types)
                held = {}
        if held:
            yield blocks(held, types)

    def blocks(held: dict[tuple, np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        cuts = range(0, iterations, PIECE)
        columns = [pa.array([g[k] for g in held for _ in cuts], types[k]) for k in range(len(by))]
        columns += [pa.array([c // PIECE for _ in held for c in cuts], pa.int32()), *(pa.array([a[k, c : c + PIECE] for a in held.values() for c in cuts], pa.list_(pa.float64())) for k in (0, 1))]
        return pa.record_batch(columns, names=[*by, "piece", "times", "total"])

    name = F.concat_ws(":", *[F.col(k).cast("string") for k in key])
    # few bytes but much work: Spark would put such rows into one task
    drawn_for = cut(rows.select(*by, name.alias("__name"), F.col(value).cast("double").alias("__x")))
    n, cores = drawn_for.count(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-n // MOST), min(3 * cores, -(-n // LEAST)))
    each = drawn_for.repartition(tasks, "__name").mapInArrow(sums, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "piece int, times array<double>, total array<double>"]))
    both = each.select(*by, "piece", F.posexplode(F.arrays_zip("times", "total")).alias("i", "z")).groupBy(*by, "piece", "i").agg(F.sum("z.times").alias("times"), F.sum("z.total").alias("total"))
    means = both.select(*by, (F.col("total") / F.nullif(F.col("times"), F.lit(0.0))).alias("m"))
    ordered = F.sort_array(F.collect_list("m"))  # iterations numbers
    at = lambda q: F.get(F.col("m"), F.least(F.size("m") - 1, F.floor(q * F.size("m")).cast("int")))
    return means.groupBy(*by).agg(ordered.alias("m")).select(*by, at(0.025).alias("low"), at(0.975).alias("high"))


def pareto(rows: DataFrame, key: str, higher: str, *lower: str) -> DataFrame:
    """Rows that no other beats: as good in all measures and better in one. ``rows`` is a table of configurations."""
    a, b = rows.alias("a"), rows.alias("b")
    no_worse = F.col(f"b.{higher}") >= F.col(f"a.{higher}")
    better = F.col(f"b.{higher}") > F.col(f"a.{higher}")
    for c in lower:
        no_worse, better = no_worse & (F.col(f"b.{c}") <= F.col(f"a.{c}")), better | (F.col(f"b.{c}") < F.col(f"a.{c}"))
    return a.join(b, no_worse & better, "left_anti").select("a.*")


def best_under_budget(rows: DataFrame, limit: float | DataFrame, size: str, *order: Column) -> DataFrame:
    """The first row by ``order`` among those of at most ``limit``: a number, or the one value of a table."""
    if isinstance(limit, DataFrame):
        fit = rows.crossJoin(F.broadcast(limit.toDF("__limit"))).where(F.col(size) <= F.col("__limit")).drop("__limit")
    else:
        fit = rows.where(F.col(size) <= limit)
    return fit.orderBy(*order).limit(1)
