"""Reads and statistics of a memory's records as of a time.

Records: (stream, record_id, slot, write_time, superseded_by, vector, value, ...).
A record is current if nothing supersedes it; as of a time, if it was written
by then and its superseder wasn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions.vector import kappa


def supersede_by_group(writes: DataFrame, group: str = "conflict_group", order: str = "write_time") -> DataFrame:
    """Each write of a conflict group supersedes the one before it: adds superseded_by and superseded_at."""
    w = Window.partitionBy("stream", group).orderBy(order, "record_id")
    return writes.withColumns({"superseded_by": F.lead("record_id").over(w), "superseded_at": F.lead(order).over(w)})


def visible(records: DataFrame, policy: str, as_of: Column | float | None = None) -> DataFrame:
    """Records that a read may see: all, current, or historical (``as_of`` a time)."""
    if policy == "all":
        return records
    if policy == "current":
        return records.where(F.col("superseded_by").isNull())
    if policy != "historical" or as_of is None:
        raise ValueError("policy must be all, current, or historical with as_of")
    at = as_of if isinstance(as_of, Column) else F.lit(float(as_of))
    return records.where((F.col("write_time") <= at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > at)))


def slot_statistics(records: DataFrame, dims: int, weight: Column | None = None, prior: float = 1.0, largest: float = 100.0) -> DataFrame:
    """(stream, slot): mass, resultant length, concentration, scatter, time range.

    The resultant is a sum for each dimension; a slot's rows never meet in one task.
    """
    w = F.lit(1.0) if weight is None else weight
    rows = records.withColumn("w", w)
    time = rows.groupBy("stream", "slot").agg(F.count("*").alias("records"), F.sum("w").alias("mass"), F.min("write_time").alias("first_time"), F.max("write_time").alias("last_time"))
    sums = rows.select("stream", "slot", "w", F.posexplode("vector").alias("dim", "x")).groupBy("stream", "slot", "dim").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    length = sums.groupBy("stream", "slot").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    out = time.join(length, ["stream", "slot"])
    r = F.when(F.col("mass") > 0, F.col("norm") / F.col("mass")).otherwise(0.0)
    # unit vectors: the scatter about the centroid is the mass less the resultant
    return out.select("stream", "slot", "records", "mass", r.alias("resultant"), kappa(F.col("norm") / (F.col("mass") + prior), dims, largest).alias("concentration"), (F.col("mass") - F.col("norm")).alias("scatter"), "first_time", "last_time")


def centroids(records: DataFrame, by: list[str], column: str = "vector", weight: Column | None = None) -> DataFrame:
    """Weighted mean of a vector column by dimension: (by..., dim, mean)."""
    w = F.lit(1.0) if weight is None else weight
    return records.withColumn("w", w).select(*by, "w", F.posexplode(column).alias("dim", "x")).groupBy(*by, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))


def eviction_priority(now: Column, written: Column, used: Column, times: Column, gain: Column, size: Column, idle_decay: float = 0.0) -> Column:
    """How much a record's bytes are worth: its rate of reuse, less for idle time, times its gain, over its bytes. The least go first."""
    idle, age = F.greatest(F.lit(0.0), now - F.coalesce(used, written)), F.greatest(F.lit(0.0), now - written)
    return (times + 1.0) / (age + times + 1.0) * F.exp(-idle_decay * idle) * F.greatest(F.lit(0.0), gain) / F.greatest(F.lit(1), size)


def split_distance(vector: Column, centre: Column, value: Column, its_value: Column, time: Column, its_time: Column, now: Column, value_weight: float = 0.0, time_weight: float = 0.0) -> Column:
    """1 less the cosine to a centre, and weighted: 1 less the cosine of the values (if neither is zero), and the times' distance over the time since the earlier."""
    from mnemolith.functions.vector import cosine, dot, norm

    out = 1 - dot(vector, centre)
    if value_weight:
        out = out + F.when((norm(value) > 0) & (norm(its_value) > 0), value_weight * (1 - cosine(value, its_value))).otherwise(0.0)
    if time_weight:
        out = out + time_weight * F.abs(time - its_time) / F.greatest(F.lit(1.0), now - F.least(time, its_time))
    return out


def parent_bytes(parents: DataFrame) -> DataFrame:
    """Of (dims, children): 160 for each parent, and 8 for each number and child."""
    return parents.agg(F.coalesce(F.sum(160 + 8 * (F.col("dims") + F.col("children"))), F.lit(0)).cast("long").alias("parent_bytes"))


def memory_bytes(records: DataFrame, slots: DataFrame) -> DataFrame:
    """Accounted bytes: 160 and 8 for each number of a record, 192 and 8 for each number and record of a slot."""
    r = records.agg(F.coalesce(F.sum(160 + 8 * (F.size("vector") + F.size("key") + F.size("value"))), F.lit(0)).cast("long").alias("record_bytes"))
    s = slots.agg(F.coalesce(F.sum(192 + 8 * (F.col("dims") + F.col("records"))), F.lit(0)).cast("long").alias("slot_bytes"))
    return r.crossJoin(s).withColumn("bytes", F.col("record_bytes") + F.col("slot_bytes"))


def read_metrics(reads: DataFrame, *by: str) -> DataFrame:
    """Rates over reads (expected, stale, absent, results): results are the sources of each result, in order.

    Top-1 (all sources of the first result are expected), recall and stale rates divide by reads that have
    an answer, abstention by those that have none, wrong injections by all reads.
    """
    first, some, answered = F.get("results", F.lit(0)), F.size("results") > 0, ~F.col("absent")
    meets = lambda a, b: F.size(F.array_intersect(a, F.col(b))) > 0
    inside = lambda a: F.size(F.array_except(a, F.col("expected"))) == 0
    any_of = lambda f: F.coalesce(F.exists("results", f), F.lit(False))
    top1 = F.coalesce(some & meets(first, "expected") & inside(first), F.lit(False))
    wrong = F.when(F.col("absent"), some).otherwise(any_of(lambda r: ~inside(r)))
    rate = lambda c, of: F.coalesce(F.sum(F.when(of & c, 1.0).otherwise(0.0)) / F.nullif(F.sum(F.when(of, 1.0).otherwise(0.0)), F.lit(0.0)), F.lit(0.0))
    return reads.groupBy(*by).agg(
        F.count("*").alias("queries"), rate(top1, answered).alias("top1_accuracy"), rate(any_of(lambda r: meets(r, "expected")), answered).alias("recall_at_k"), rate(~some, ~answered).alias("absent_abstention"),
        rate(wrong, F.lit(True)).alias("wrong_injection_rate"), rate(any_of(lambda r: meets(r, "stale")), answered).alias("stale_injection_rate"),
    )


def ema_fold(values: Column, rate: float, start: float = 0.0) -> Column:
    """Exponential moving average after an ordered array of values."""
    return F.aggregate(values, F.lit(float(start)), lambda s, v: s * (1 - rate) + v.cast("double") * rate)


def cross_supersession(records: DataFrame) -> DataFrame:
    """(slot, other): slots one of whose records is superseded by one of the other's; such a pair mustn't merge."""
    later = records.select("stream", F.col("record_id").alias("superseded_by"), F.col("slot").alias("other"))
    return records.select("stream", "slot", "superseded_by").join(later, ["stream", "superseded_by"]).where("slot <> other").select("slot", "other").distinct()


def centroid_payload(records: DataFrame) -> DataFrame:
    """(slot, n, one_text, sources): how many records a slot has, whether all have the same key and value, and their sources."""
    same = F.count_distinct(F.struct("key", "value")) == 1
    return records.groupBy("slot").agg(F.count("*").alias("n"), same.alias("one_text"), F.sort_array(F.collect_set("source")).alias("sources"))


def regret(records: DataFrame, centres: DataFrame) -> DataFrame:
    """(slot, regret): the mean over a slot's records of 1 less the largest cosine to its centres (slot, centre)."""
    from mnemolith.functions.vector import dot

    near = records.join(centres, "slot").groupBy("slot", "record_id").agg(F.max(dot(F.col("vector"), F.col("centre"))).alias("c"))
    return near.groupBy("slot").agg(F.avg(1 - F.col("c")).alias("regret"))


def evicted(records: DataFrame, budget: int) -> DataFrame:
    """Records (stream, record_id, priority, size) that go, least priority first, until what stays of a stream fits ``budget`` bytes."""
    w = Window.partitionBy("stream")
    before = F.coalesce(F.sum("size").over(w.orderBy("priority", "record_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return records.withColumn("left", F.sum("size").over(w) - before).where(F.col("left") > budget).drop("left")


def allocation_order(slots: DataFrame) -> DataFrame:
    """Slots (stream, slot, used, touched_now, age) with the rank in which writes take them: free ones, then untouched ones from the oldest, then touched ones."""
    kind = F.when(~F.col("used"), 0).when(~F.col("touched_now"), 1).otherwise(2)
    return slots.withColumn("rank", F.row_number().over(Window.partitionBy("stream").orderBy(kind, F.when(F.col("used"), -F.col("age")).otherwise(F.lit(0)), "slot")))


def assignment_posterior(vectors: DataFrame, slots: DataFrame, dims: int, alpha: float = 0.1, exponent: float = 0.5) -> DataFrame:
    """(id, slot, p): of unit vectors (id, grp, vector), how likely each is of a slot (grp, slot, records, concentration, mean) of its group, or of a new one (slot -1)."""
    from mnemolith.functions.vector import cosine, softmax, sphere_log_density, vmf_log_normalizer

    near = exponent * F.log(F.col("records").cast("double")) + vmf_log_normalizer(F.col("concentration"), dims) + F.col("concentration") * cosine(F.col("vector"), F.col("mean"))
    held = vectors.join(slots, "grp").select("id", "slot", near.alias("score"))
    new = vectors.select("id", F.lit(-1).cast("long").alias("slot"), (F.log(F.lit(alpha)) + sphere_log_density(dims)).alias("score"))
    return held.unionByName(new).withColumn("p", softmax(F.col("score"), "id")).drop("score")


def effective_baseline(metrics: DataFrame, least_recall: float, least_top1: float) -> DataFrame:
    """The best row (by recall_at_k, then top1_accuracy) of (method, recall_at_k, top1_accuracy); an error if even that is too weak to compare with."""
    best = metrics.agg(F.max_by(F.struct("method", "recall_at_k", "top1_accuracy"), F.struct("recall_at_k", "top1_accuracy", "method")).alias("b")).select("b.*")
    weak = (F.col("recall_at_k") < least_recall) | (F.col("top1_accuracy") < least_top1)
    return best.withColumn("method", F.when(weak, F.raise_error(F.concat(F.lit("too weak a baseline: "), "method"))).otherwise(F.col("method")))
