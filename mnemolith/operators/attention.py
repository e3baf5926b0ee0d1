"""Attention mass of blocks, its distributions, and measures against them.

Attention is long: (sample_id, layer, head, future_index, key_position, p).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions.vector import TINY, softmax
from mnemolith.session import cut

#: Queries, and rows of memory, that meet at once.
PART = 4096


def block_mass(attention: DataFrame, block: int, layers: list[int] | None = None) -> DataFrame:
    """(sample_id, future_index, block_index, mass): the mean over layers and heads, summed over a block's keys.

    Equal blocks, so the key's block is arithmetic; one aggregation does mean and sum.
    """
    chosen = attention if layers is None else attention.where(F.col("layer").isin(layers))
    pairs = chosen.groupBy("sample_id", "future_index", F.floor(F.col("key_position") / block).cast("int").alias("block_index"), "layer", "head").agg(F.sum("p").alias("mass"))
    return pairs.groupBy("sample_id", "future_index", "block_index").agg(F.avg("mass").alias("mass"))


def block_target(per_future: DataFrame, weights: Column | None = None, lengths: Column | None = None, least: float = TINY) -> DataFrame:
    """(sample_id, block_index, absolute, total, conditional): mean over futures; shares of the total, 0 if there is none.

    ``weights``: of each future (default equal); ``lengths``: divides the masses before they become shares.
    """
    w = F.lit(1.0) if weights is None else weights
    mass = per_future.groupBy("sample_id", "block_index").agg((F.sum(F.col("mass") * w) / F.sum(w)).alias("absolute"))
    basis = F.col("absolute") if lengths is None else F.col("absolute") / lengths
    by = Window.partitionBy("sample_id")
    return mass.withColumn("total", F.sum("absolute").over(by)).withColumn("conditional", F.when(F.sum(basis).over(by) > least, basis / F.sum(basis).over(by)).otherwise(F.lit(0.0)))


def router_metrics(scores: DataFrame, target: DataFrame, top_n: int) -> DataFrame:
    """One row: mean cross-entropy, KL, entropies, top-1, recall and coverage at ``top_n`` over samples with mass.

    scores: (sample_id, block_index, score); target: as block_target gives it.
    """
    s = Window.partitionBy("sample_id")
    rows = scores.join(target, ["sample_id", "block_index"]).where(F.col("total") > TINY)
    rows = rows.withColumn("q", softmax(F.col("score"), "sample_id")).withColumns({
        "by_score": F.row_number().over(s.orderBy(F.desc("score"), "block_index")),
        "by_mass": F.row_number().over(s.orderBy(F.desc("conditional"), "block_index")),
    })
    p, log_q, log_p = F.col("conditional"), F.log(F.greatest(F.col("q"), F.lit(TINY))), F.log(F.greatest(F.col("conditional"), F.lit(TINY)))
    each = rows.groupBy("sample_id").agg(
        F.sum(-p * log_q).alias("ce"), F.sum(p * (log_p - log_q)).alias("kl"), F.sum(-p * log_p).alias("target_entropy"), F.sum(-F.col("q") * log_q).alias("predicted_entropy"),
        F.max(F.when((F.col("by_score") == 1) & (F.col("by_mass") == 1), 1.0).otherwise(0.0)).alias("top1"),
        (F.sum(F.when((F.col("by_score") <= top_n) & (F.col("by_mass") <= top_n), 1.0).otherwise(0.0)) / F.sum(F.when(F.col("by_mass") <= top_n, 1.0).otherwise(0.0))).alias("recall"),
        F.sum(F.when(F.col("by_score") <= top_n, p).otherwise(0.0)).alias("coverage"), F.sum(F.when(F.col("by_mass") <= top_n, p).otherwise(0.0)).alias("oracle_coverage"),
    )
    names = ("ce", "kl", "target_entropy", "predicted_entropy", "top1", "recall", "coverage", "oracle_coverage")
    return each.agg(F.count("*").alias("samples"), *[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names])


def event_summary(events: DataFrame, by: list[str]) -> DataFrame:
    """Of (by..., event, head, length, key_len, mass): mean tokens, mean and largest head mass, enrichment over uniform, heads at twice uniform."""
    heads = events.groupBy(*by, "head").agg(F.avg("mass").alias("mass"), F.avg("length").alias("length"), F.avg(F.col("length") / F.col("key_len")).alias("uniform"))
    enriched = F.when(F.col("uniform") > 0, F.col("mass") / F.col("uniform")).otherwise(0.0)
    return heads.groupBy(*by).agg(
        F.avg("length").alias("mean_tokens"), F.avg("mass").alias("mean_mass"), F.max("mass").alias("max_head_mass"),
        F.when(F.avg("uniform") > 0, F.avg("mass") / F.avg("uniform")).otherwise(0.0).alias("enrichment"), F.sum(F.when(enriched >= 2, 1).otherwise(0)).cast("long").alias("heads_twice"),
    )


def readout(queries: DataFrame, memory: DataFrame, by: str, dims: int) -> DataFrame:
    """(query_id, dim, value): softmax(q.k / sqrt(d) + ln n) of queries (query_id, ``by``, q) over the memory (``by``, id, key, value, n) of their ``by``, applied to the values.

    Queries and memory of a ``by`` are dealt to parts of bounded size; a pair of parts gives each of its queries the largest
    score, the sum of the others over it and the sum of values, and those meet. No pair of a query and a key is a row.
    Keys or values that are null or hold null take no part; a query that is null or meets no others has null values.
    """
    shape = f"query_id {dict(queries.dtypes)['query_id']}, top double, weight double, total array<double>"

    def met(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        out = {"query_id": asked["query_id"], "top": np.full(len(asked), -np.inf), "weight": np.zeros(len(asked)), "total": np.zeros((len(asked), dims))}
        some = np.flatnonzero([x is not None and None not in x for x in asked["q"].to_pylist()])
        if len(some) and len(known):
            rows = lambda t, c: np.asarray(pc.list_flatten(t[c])).reshape(-1, dims)
            n, values = known["n"].to_numpy(), rows(known, "value")
            # a part's scores are at most PART squared
            score = rows(asked.take(pa.array(some)), "q") @ rows(known, "key").T / math.sqrt(dims) + np.log(n)
            out["top"][some] = top = score.max(axis=1)
            e = np.exp(score - top[:, None])
            out["weight"][some], out["total"][some] = e.sum(axis=1), e @ values
        out["total"] = pa.FixedSizeListArray.from_arrays(pa.array(out["total"].ravel()), dims).cast(pa.list_(pa.float64()))
        return pa.table({k: x if k in ("query_id", "total") else pa.array(x) for k, x in out.items()})

    number = lambda c: F.col(c).cast("array<double>").alias(c)
    q = queries.where(F.col(by).isNotNull()).select(by, "query_id", number("q"))
    m = memory.where(F.col(by).isNotNull()).select(by, "id", number("key"), number("value"), F.col("n").cast("double").alias("n"))
    sound = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    parts = lambda df, name: df.groupBy(by).agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    sizes = cut(parts(q, "__asked").join(parts(m, "__known"), by))
    own = lambda df, n, id_: df.join(sizes, by).withColumn("__own", F.pmod(F.xxhash64(id_), F.col(n)).cast("int"))
    other = lambda df, n: df.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    asked = other(own(q, "__asked", "query_id"), "__known").select(F.col(by).alias(by), F.col("__own").alias("__a"), F.col("__other").alias("__k"), "query_id", "q")
    known = other(own(m.where(sound("key") & sound("value") & F.col("n").isNotNull()), "__known", "id"), "__asked").select(F.col(by).alias(by), F.col("__other").alias("__a"), F.col("__own").alias("__k"), "key", "value", "n")
    pairs = [by, "__a", "__k"]
    some = cut(asked.groupBy(*pairs).cogroup(known.groupBy(*pairs)).applyInArrow(met, shape).where("query_id IS NOT NULL"))
    most = some.groupBy("query_id").agg(F.max("top").alias("most"))
    weighed = some.join(most, "query_id").withColumn("__w", F.when(F.col("weight") > 0, F.exp(F.col("top") - F.col("most"))).otherwise(F.lit(0.0)))
    each = weighed.select("query_id", "__w", "weight", F.posexplode("total").alias("dim", "x"))
    return each.groupBy("query_id", "dim").agg((F.sum(F.col("__w") * F.col("x")) / F.nullif(F.sum(F.col("__w") * F.col("weight")), F.lit(0.0))).alias("value"))


def future_mass_by_head(attention: DataFrame, block: int) -> DataFrame:
    """(sample_id, layer, head, future_index, block_index, mass): nothing is averaged."""
    at = F.floor(F.col("key_position") / block).cast("int").alias("block_index")
    return attention.groupBy("sample_id", "layer", "head", "future_index", at).agg(F.sum("p").alias("mass"))


def region_mass(attention: DataFrame, regions: DataFrame, keys: int) -> DataFrame:
    """(sample_id, layer, head, future_index, region, length, mass) over the ranges (sample_id, region, start_position, end_position), cut to [0, ``keys``)."""
    cut_ = regions.withColumns({"start_position": F.greatest(F.lit(0), "start_position"), "end_position": F.least(F.lit(keys), "end_position")}).where("end_position > start_position")
    lengths = cut_.groupBy("sample_id", "region").agg(F.sum(F.col("end_position") - F.col("start_position")).alias("length"))
    inside = attention.join(cut_, "sample_id").where("key_position >= start_position AND key_position < end_position")
    mass = inside.groupBy("sample_id", "layer", "head", "future_index", "region").agg(F.sum("p").alias("mass"))
    return mass.join(lengths, ["sample_id", "region"])


def sample_faults(samples: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """(sample_id, fault) of samples (sample_id, sequence_id, local_start, local_end, retrieval_position, first_future_position, horizon, query, ids, ends, vectors, absolute, total, conditional)."""
    finite = lambda a: F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n, sums = F.size("ids"), {c: total(F.col(c)) for c in ("absolute", "conditional")}
    rules = {
        "empty id": (F.col("sample_id") == "") | (F.col("sequence_id") == ""), "local range": (F.col("local_start") < 0) | (F.col("local_end") <= F.col("local_start")),
        "position outside": (F.col("retrieval_position") < F.col("local_start")) | (F.col("retrieval_position") >= F.col("local_end")), "future not after": F.col("first_future_position") <= F.col("retrieval_position"),
        "horizon": F.col("horizon") <= 0, "no candidates": n == 0, "ids repeat": F.size(F.array_distinct("ids")) < n, "block in window": F.exists("ends", lambda e: e > F.col("local_start")),
        "not finite": ~(finite(F.col("query")) & finite(F.flatten("vectors")) & finite(F.col("absolute")) & finite(F.col("conditional"))),
        "dimensions": F.exists("vectors", lambda v: F.size(v) != F.size("query")) | (F.size("vectors") != n), "mass per block": (F.size("absolute") != n) | (F.size("conditional") != n),
        "negative mass": F.exists("absolute", lambda x: x < 0) | F.exists("conditional", lambda x: x < 0) | (F.col("total") < 0),
        "total": F.abs(F.col("total") - sums["absolute"]) > tolerance * F.greatest(F.lit(1.0), F.col("total"), sums["absolute"]),
        "not a distribution": (F.col("total") > tolerance) & (F.abs(sums["conditional"] - 1) > tolerance), "mass of nothing": (F.col("total") <= tolerance) & (sums["conditional"] > tolerance),
    }
    return samples.select("sample_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))).alias("fault"))
