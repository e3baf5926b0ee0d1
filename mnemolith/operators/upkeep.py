"""Upkeep of a live memory: expiry, a budget, pruning, splits and merges, in that order, over all streams at once.

A memory is three tables:

- records (stream, record_id, slot, vector, value, write_time, last_used, reads, gain, superseded_by, size);
- nodes (stream, node, parent, leaf, pending, cooldown_until, regret): a tree whose leaves are slots;
- costs (stream, cost): the price of a byte, which a controller raises while a stream is over its budget.

``maintain`` gives the memory after one round and a report of what it did. A
round is joins, windows and aggregations over these tables; counters that must
last from round to round (pending splits, cooldowns, the price) are columns.
``advance`` takes a batch of writes to the leaves they are nearest to, as these
were before the batch, and runs a round when the time for it has come; ``live``
does so from a stream. The tables are kept as versions in a folder, so a batch
that is run again after a loss writes the same version again.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from mnemolith.functions.vector import dot, unit
from mnemolith.operators.asof import kept_nodes
from mnemolith.session import cut

RECORD = "stream string, record_id long, slot long, vector array<double>, value array<double>, write_time double, last_used double, reads long, gain double, superseded_by long, size long"
NODE = "stream string, node long, parent long, leaf boolean, pending int, cooldown_until double, regret double"
COST = "stream string, cost double"
REPORT = "stream string, what string, id long, other long"


class Memory(NamedTuple):
    records: DataFrame
    nodes: DataFrame
    costs: DataFrame


@dataclass(frozen=True)
class Upkeep:
    """Rules of a round; the names say what each bounds."""

    age_decay: float = 0.0
    idle_decay: float = 0.0
    gain_power: float = 0.0
    protection: float = 0.0  # age from which a record may go
    least_weight: float = 0.0
    budget: int | None = None  # bytes of a stream
    budget_step: float = 0.0
    split_least_resultant: float = 0.0
    split_least_gain: float = 1.0
    split_most_regret: float = 1.0
    split_most_conflict: float = 1.0
    least_child_mass: float = 1.0
    slot_penalty: float = 0.0
    patience: int = 1
    split_cooldown: float = 0.0
    merge_least_similarity: float = 2.0  # above 1: never
    merge_most_conflict: float = 1.0
    merge_most_regret: float = 1.0
    merge_cooldown: float = 0.0
    rounds: int = 50


def weighed(records: DataFrame, now: float, u: Upkeep) -> DataFrame:
    """Adds ``w``: how much a record counts at ``now``; one that is superseded counts nothing."""
    age = F.greatest(F.lit(0.0), now - F.col("write_time"))
    idle = F.greatest(F.lit(0.0), now - F.coalesce("last_used", "write_time"))
    w = F.exp(-u.age_decay * age) * F.exp(-u.idle_decay * idle) * F.pow(1e-6 + F.greatest(F.lit(0.0), "gain"), F.lit(u.gain_power))
    return records.withColumn("w", F.when(F.col("superseded_by").isNull(), w).otherwise(0.0))


def priority(now: float, u: Upkeep) -> Column:
    """What a record's bytes are worth; the least go first."""
    idle, age = F.greatest(F.lit(0.0), now - F.coalesce("last_used", "write_time")), F.greatest(F.lit(0.0), now - F.col("write_time"))
    return (F.col("reads") + 1.0) / (age + F.col("reads") + 1.0) * F.exp(-u.idle_decay * idle) * F.greatest(F.lit(0.0), "gain") / F.greatest(F.lit(1), "size")


def expired(records: DataFrame, now: float, u: Upkeep) -> DataFrame:
    """Records that are old enough to go and weigh too little."""
    return weighed(records, now, u).where((now - F.col("write_time") >= u.protection) & (F.col("w") < u.least_weight)).drop("w")


def over_budget(records: DataFrame, nodes: DataFrame, costs: DataFrame, now: float, u: Upkeep) -> tuple[DataFrame, DataFrame]:
    """(records that go, the new prices). A record goes while what is held is over the budget, or while its worth is no more than the price of its bytes.

    Bytes: a record's size and 8 for its place in a slot; 192 and 8 for each number of a leaf's centre, 160 and 8 for each number and child of a parent.
    """
    dims = records.groupBy("stream").agg(F.max(F.size("vector")).alias("dims"))
    children = nodes.where("parent IS NOT NULL").groupBy("stream", F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    tree = nodes.join(dims, "stream").join(children, ["stream", "node"], "left")
    tree = tree.groupBy("stream").agg(F.sum(F.when(F.col("leaf"), 192 + 8 * F.col("dims")).otherwise(160 + 8 * (F.col("dims") + F.coalesce("children", F.lit(0))))).alias("tree"))
    held = records.groupBy("stream").agg(F.sum(F.col("size") + 8).alias("held")).join(tree, "stream", "left").select("stream", (F.col("held") + F.coalesce("tree", F.lit(0))).alias("bytes"))
    price = held.join(costs, "stream", "left").select("stream", "bytes", F.greatest(F.lit(0.0), F.coalesce("cost", F.lit(0.0)) + u.budget_step * (F.col("bytes") - u.budget)).alias("cost"))
    price = cut(price)
    able = records.where(now - F.col("write_time") >= u.protection).withColumn("worth", priority(now, u))
    before = F.coalesce(F.sum(F.col("size") + 8).over(Window.partitionBy("stream").orderBy("worth", "record_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # both conditions fail from some record on, in order of worth, so no record behind one that stays goes
    going = able.withColumn("gone", before).join(price, "stream").where((F.col("bytes") - F.col("gone") > u.budget) | (F.col("worth") <= F.col("cost")))
    kept = costs.join(price, "stream", "left_anti").unionByName(price.select("stream", "cost"))
    return going.select(records.columns), kept


def resultants(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., mass, resultant array, n, scatter) of weighted unit vectors, by dimension; no group is gathered but for its sums."""
    sums = rows.select(*by, F.posexplode(F.transform("vector", lambda x: x * F.col("w"))).alias("dim", "x")).groupBy(*by, "dim").agg(F.sum("x").alias("x"))
    whole = sums.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda z: z["x"]).alias("resultant"))
    out = rows.groupBy(*by).agg(F.sum("w").alias("mass"), F.count("*").alias("n")).join(whole, list(by))
    return out.withColumn("scatter", F.col("mass") - F.sqrt(dot(F.col("resultant"), F.col("resultant"))))


def conflict(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., conflict): 1 less the mean resultant length of the values' directions, weighted; 0 where no value weighs. By sums, without pairs."""
    some = rows.where((F.col("w") > 0) & (dot(F.col("value"), F.col("value")) > 0)).select(*by, "w", unit(F.col("value")).alias("vector"))
    return resultants(some, *by).select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("scatter") / F.col("mass"))).alias("conflict"))


def _length(v: str) -> Column:
    return F.sqrt(dot(F.col(v), F.col(v)))


KEY = ["stream", "slot"]


def halves(rows: DataFrame, rounds: int) -> DataFrame:
    """(stream, slot, record_id, side): two means of every slot's records (with ``w``); slots whose records fall on one side have no rows.

    Seeds: the record farthest from the slot's direction, and the one farthest from that; ties by id. Sides start at the
    nearer seed (0 if equal) and move until no record changes sides.
    """
    rows = cut(rows.select(*KEY, "record_id", "vector", "w"))
    at = lambda to: F.min_by(F.struct("record_id", "vector"), F.struct(F.round(dot(F.col("vector"), F.col(to)), 12), F.col("record_id")))
    plain = resultants(rows.withColumn("w", F.lit(1.0)), *KEY).where("n > 1").select(*KEY, "resultant")
    first = rows.join(plain, KEY).groupBy(*KEY).agg(at("resultant").alias("a"))
    first = first.select(*KEY, F.col("a.record_id").alias("first"), F.col("a.vector").alias("c0"))
    other = rows.join(first, KEY).where("record_id <> first").groupBy(*KEY).agg(F.first("c0").alias("c0"), at("c0").alias("b"))
    seeds, before = cut(other.select(*KEY, "c0", F.col("b.vector").alias("c1"))), None
    for _ in range(rounds):
        # 0 where it is as near: rounded, so that a tie is one whatever the order of a sum
        side = F.when(F.round(dot(F.col("vector"), F.col("c1")), 12) > F.round(dot(F.col("vector"), F.col("c0")), 12), 1).otherwise(0)
        sided = cut(rows.join(seeds, KEY).select(*KEY, "record_id", "vector", "w", side.alias("side")))
        mark = sided.agg(F.coalesce(F.bit_xor(F.xxhash64("stream", "slot", "record_id", "side")), F.lit(0)), F.count_if(F.col("side") == 1)).first()
        if mark == before:
            break
        before = mark
        sums = resultants(sided, *KEY, "side")
        # a side without weight keeps a record of its own as its centre
        lone = sided.groupBy(*KEY, "side").agg(F.min_by("vector", "record_id").alias("lone"))
        centre = sums.join(lone, [*KEY, "side"]).select(*KEY, "side", F.when(_length("resultant") > 1e-15, unit(F.col("resultant"))).otherwise(F.col("lone")).alias("c"))
        both = centre.groupBy(*KEY).agg(F.max(F.when(F.col("side") == 0, F.col("c"))).alias("c0"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("c1"))
        seeds = cut(both.where("c0 IS NOT NULL AND c1 IS NOT NULL"))
    whole = sided.groupBy(*KEY).agg(F.count_distinct("side").alias("sides")).where("sides = 2").select(*KEY)
    return sided.join(whole, KEY, "left_semi").select(*KEY, "record_id", "side")


def split_decisions(records: DataFrame, nodes: DataFrame, now: float, u: Upkeep) -> tuple[DataFrame, DataFrame]:
    """(leaves: stream, slot, gain, drop, pending, accepted; sides of their records).

    A split is due if a leaf is scattered, would gain enough, is read with regret or holds values in conflict; it is valid if both
    sides weigh enough and the distortion falls by more than a slot's penalty; it is done once it has been valid for ``patience``
    rounds running and lowers the mean distance of records to their centres. A leaf that cools down waits and keeps its count.
    """
    rows = cut(weighed(records, now, u))
    ready = nodes.where(F.col("leaf") & (F.col("cooldown_until") <= now)).select("stream", F.col("node").alias("slot"), "pending", "regret")
    sides = cut(halves(rows.join(ready.select(*KEY), KEY, "left_semi"), u.rounds))
    sided = cut(rows.join(sides, [*KEY, "record_id"]))
    whole = resultants(rows, *KEY).select(*KEY, "mass", F.col("resultant").alias("r"), F.col("scatter").alias("j1"))
    part = resultants(sided, *KEY, "side").select(*KEY, "side", F.col("mass").alias("m"), F.col("resultant").alias("rs"), "scatter")
    pair = part.groupBy(*KEY).agg(F.min("m").alias("least_mass"), F.sum("scatter").alias("j2"))
    # mean distance to one centre and to two, records counting alike
    far = lambda r: 1 - dot(F.col("vector"), unit(F.col(r)))
    regret = sided.join(whole.select(*KEY, "r"), KEY).join(part.select(*KEY, "side", "rs"), [*KEY, "side"]).groupBy(*KEY).agg(F.avg(far("r")).alias("before"), F.avg(far("rs")).alias("after"))
    d = ready.join(whole, KEY).join(conflict(rows, *KEY), KEY, "left").join(pair, KEY, "left").join(regret, KEY, "left")
    drop = F.col("j1") - F.col("j2")
    gain = F.when(F.col("j1") > 1e-15, drop / F.col("j1")).otherwise(0.0)
    length = F.when(F.col("mass") > 0, _length("r") / F.col("mass")).otherwise(0.0)
    due = (length < u.split_least_resultant) | (gain > u.split_least_gain) | (F.col("regret") > u.split_most_regret) | (F.coalesce("conflict", F.lit(0.0)) > u.split_most_conflict)
    valid = F.coalesce(due & (F.col("least_mass") >= u.least_child_mass) & (drop > u.slot_penalty), F.lit(False))
    pending = F.when(valid, F.col("pending") + 1).otherwise(0)
    accepted = (pending >= u.patience) & (F.col("after") < F.col("before") - 1e-12)
    return cut(d.select(*KEY, gain.alias("gain"), drop.alias("drop"), pending.cast("int").alias("pending"), F.coalesce(valid & accepted, F.lit(False)).alias("accepted"))), sides


def split(m: Memory, now: float, u: Upkeep) -> tuple[Memory, DataFrame]:
    """Leaves whose split is accepted become parents of two new leaves; the others keep their counts."""
    decided, sides = split_decisions(m.records, m.nodes, now, u)
    done = decided.where("accepted")
    top = m.nodes.groupBy("stream").agg(F.max("node").alias("top"))
    numbered = cut(done.join(top, "stream").withColumn("new", F.col("top") + 2 * F.row_number().over(Window.partitionBy("stream").orderBy("slot")) - 1).select(*KEY, "new"))
    moved = m.records.join(sides.join(numbered, KEY).select(*KEY, "record_id", (F.col("new") + F.col("side")).alias("to")), [*KEY, "record_id"], "left")
    records = moved.withColumn("slot", F.coalesce("to", "slot")).select(m.records.columns)
    split_ = numbered.select("stream", F.col("slot").alias("node"), "new")
    counted = decided.select("stream", F.col("slot").alias("node"), F.col("pending").alias("counted"))
    old = m.nodes.join(counted, ["stream", "node"], "left").join(split_, ["stream", "node"], "left")
    is_split = F.col("new").isNotNull()
    old = old.select("stream", "node", "parent", (F.col("leaf") & ~is_split).alias("leaf"), F.when(is_split, 0).otherwise(F.coalesce("counted", "pending")).alias("pending"), F.when(is_split, now + u.split_cooldown).otherwise(F.col("cooldown_until")).alias("cooldown_until"), "regret")
    young = split_.select("stream", F.explode(F.array(F.col("new"), F.col("new") + 1)).alias("node"), F.col("node").alias("parent")).select("stream", "node", "parent", F.lit(True).alias("leaf"), F.lit(0).alias("pending"), F.lit(now + u.split_cooldown).alias("cooldown_until"), F.lit(0.0).alias("regret"))
    report = numbered.select("stream", F.lit("split").alias("what"), F.col("slot").alias("id"), F.col("new").alias("other"))
    return Memory(cut(records), cut(old.unionByName(young)), m.costs), report


def merge_decisions(records: DataFrame, nodes: DataFrame, now: float, u: Upkeep) -> DataFrame:
    """(stream, a, b, similarity, added): pairs of leaves of one parent that may become one, each leaf in one pair at most, the most alike first.

    Alike enough, neither in conflict, read with regret or cooling down, no record of one superseded by one of the other, and the
    distortion that merging adds (by sums alone: |ra| + |rb| - |ra + rb|) below a slot's penalty. Pairs are sought among the
    leaves of a parent, whose number the tree's own splits and merges bound.
    """
    rows = cut(weighed(records, now, u))
    calm = nodes.where(F.col("leaf") & (F.col("cooldown_until") <= now) & (F.col("regret") <= u.merge_most_regret)).select("stream", F.col("node").alias("slot"), F.coalesce("parent", F.lit(-1)).alias("under"))
    s = calm.join(resultants(rows, *KEY), KEY).join(conflict(rows, *KEY), KEY, "left").where((F.coalesce("conflict", F.lit(0.0)) <= u.merge_most_conflict) & (_length("resultant") > 1e-15))
    s = cut(s.select("stream", "under", "slot", "resultant"))
    a, b = (s.select("stream", "under", F.col("slot").alias(n), F.col("resultant").alias(f"r{n}")) for n in "ab")
    both = F.zip_with("ra", "rb", lambda x, y: x + y)
    pairs = a.join(b, ["stream", "under"]).where("a < b").withColumns({"similarity": F.round(dot(unit(F.col("ra")), unit(F.col("rb"))), 12), "both": both})
    pairs = pairs.where((F.col("similarity") >= u.merge_least_similarity) & (_length("both") > 1e-15)).withColumn("added", _length("ra") + _length("rb") - _length("both")).where(F.col("added") < u.slot_penalty)
    later = records.select("stream", F.col("record_id").alias("superseded_by"), F.col("slot").alias("other"))
    crossed = records.select("stream", "slot", "superseded_by").join(later, ["stream", "superseded_by"]).where("slot <> other").select("stream", F.least("slot", "other").alias("a"), F.greatest("slot", "other").alias("b")).distinct()
    left, taken = cut(pairs.select("stream", "a", "b", "similarity", "added").join(crossed, ["stream", "a", "b"], "left_anti")), None
    while True:  # a pair that is the best of both its ends is what taking the best first takes
        order = F.struct("similarity", -F.col("a"), -F.col("b"))
        ends = left.select("*", F.explode(F.array("a", "b")).alias("end"))
        best = ends.groupBy("stream", "end").agg(F.max_by(F.struct("a", "b", "similarity", "added"), order).alias("p")).select("stream", "p.*").groupBy("stream", "a", "b", "similarity", "added").count().where("count = 2").drop("count")
        best = cut(best)
        taken = best if taken is None else taken.unionByName(best)
        if not best.limit(1).count():
            return taken
        used = best.select("stream", F.explode(F.array("a", "b")).alias("end"))
        for end in "ab":
            left = left.join(used.withColumnRenamed("end", end), ["stream", end], "left_anti")
        left = cut(left.select("stream", "a", "b", "similarity", "added"))


def merge(m: Memory, now: float, u: Upkeep) -> tuple[Memory, DataFrame]:
    """Pairs that may merge do: a new leaf with the records of both. A parent left with one child, a new leaf, becomes that leaf."""
    pairs = merge_decisions(m.records, m.nodes, now, u)
    top = m.nodes.groupBy("stream").agg(F.max("node").alias("top"))
    order = Window.partitionBy("stream").orderBy(F.desc("similarity"), "a", "b")
    numbered = cut(pairs.join(top, "stream").withColumn("new", F.col("top") + F.row_number().over(order)).select("stream", "a", "b", "new"))
    gone = numbered.select("stream", F.explode(F.array("a", "b")).alias("node"), "new")
    left = m.nodes.join(gone.select("stream", "node"), ["stream", "node"], "left_anti")
    parent = m.nodes.select("stream", F.col("node").alias("a"), "parent")
    young = numbered.join(parent, ["stream", "a"]).select("stream", F.col("new").alias("node"), "parent", F.lit(True).alias("leaf"), F.lit(0).alias("pending"), F.lit(now + u.merge_cooldown).alias("cooldown_until"), F.lit(0.0).alias("regret"))
    nodes = cut(left.unionByName(young))
    # a parent whose only child is a leaf just made gives it its own id and place
    single = nodes.where("parent IS NOT NULL").groupBy("stream", "parent").agg(F.count("*").alias("n"), F.min("node").alias("child")).where("n = 1")
    single = single.join(young.select("stream", F.col("node").alias("child")), ["stream", "child"], "left_semi").join(nodes.select("stream", F.col("node").alias("parent"), F.col("parent").alias("above")), ["stream", "parent"])
    single = cut(single.select("stream", "child", F.col("parent").alias("own"), "above"))
    renamed = nodes.join(single.select("stream", F.col("own").alias("node")), ["stream", "node"], "left_anti").join(single.withColumnRenamed("child", "node"), ["stream", "node"], "left")
    renamed = renamed.withColumn("parent", F.when(F.col("own").isNotNull(), F.col("above")).otherwise(F.col("parent"))).withColumn("node", F.coalesce("own", "node")).select(m.nodes.columns)
    to = gone.join(single.select("stream", F.col("child").alias("new"), "own"), ["stream", "new"], "left").select("stream", F.col("node").alias("slot"), F.coalesce("own", "new").alias("to"))
    records = m.records.join(to, KEY, "left").withColumn("slot", F.coalesce("to", "slot")).select(m.records.columns)
    return Memory(cut(records), cut(renamed), m.costs), numbered.select("stream", F.lit("merge").alias("what"), F.col("a").alias("id"), F.col("b").alias("other"))


def prune(m: Memory) -> Memory:
    """Without leaves that have no records, and parents that have no children."""
    there = kept_nodes(m.nodes.select("stream", "node", "parent"), m.records.select("stream", "slot").distinct())
    return m._replace(nodes=cut(m.nodes.join(there.select("stream", "node"), ["stream", "node"], "left_semi")))


def _without(records: DataFrame, gone: DataFrame) -> DataFrame:
    return records.join(gone.select("stream", "record_id"), ["stream", "record_id"], "left_anti").select(records.columns)


def maintain(m: Memory, now: float, u: Upkeep) -> tuple[Memory, DataFrame]:
    """One round at ``now``: (the memory after it, a report: stream, what (expired, evicted, split, merge), id, other)."""
    said = lambda rows, what: rows.select("stream", F.lit(what).alias("what"), F.col("record_id").alias("id"), F.lit(None).cast("long").alias("other"))
    old = cut(expired(m.records, now, u))
    m, report = m._replace(records=cut(_without(m.records, old))), said(old, "expired")
    if u.budget is not None:
        going, costs = over_budget(m.records, m.nodes, m.costs, now, u)
        going = cut(going)
        m, report = m._replace(records=cut(_without(m.records, going)), costs=cut(costs)), report.unionByName(said(going, "evicted"))
    m = prune(m)
    m, parted = split(m, now, u)
    m, met = merge(m, now, u)
    return prune(m), cut(report.unionByName(parted).unionByName(met))


def snapshot(m: Memory, now: float, u: Upkeep) -> DataFrame:
    """Every leaf with its statistics: (stream, slot, parent, records, mass, resultant, scatter, regret, conflict)."""
    rows = cut(weighed(m.records, now, u))
    s = resultants(rows, *KEY).select(*KEY, F.col("n").alias("records"), "mass", F.when(F.col("mass") > 0, _length("resultant") / F.col("mass")).otherwise(0.0).alias("resultant"), "scatter")
    leaves = m.nodes.where("leaf").select("stream", F.col("node").alias("slot"), "parent", "regret")
    return leaves.join(s, KEY).join(conflict(rows, *KEY), KEY, "left").withColumn("conflict", F.coalesce("conflict", F.lit(0.0))).select(*KEY, "parent", "records", "mass", "resultant", "scatter", "regret", "conflict")


def counts(m: Memory) -> DataFrame:
    """(stream, records, leaves, parents) of a memory."""
    r = m.records.groupBy("stream").agg(F.count("*").alias("records"))
    n = m.nodes.groupBy("stream").agg(F.count_if("leaf").alias("leaves"), F.count_if(~F.col("leaf")).alias("parents"))
    return r.join(n, "stream", "full").select("stream", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "leaves", "parents")])


def written(m: Memory, writes: DataFrame, threshold: float, now: float, u: Upkeep) -> Memory:
    """The memory with writes (stream, record_id, vector, value, write_time, gain, supersedes, size): each in the nearest leaf, as it was before, if its cosine is ``threshold`` or more, else in a leaf of its own.

    Record ids are distinct in a stream. What a write supersedes learns of it, whether it is of this batch or an earlier one.
    """
    new = cut(writes.withColumn("vector", unit(F.col("vector"))))
    centre = resultants(weighed(m.records, now, u), *KEY).where(_length("resultant") > 1e-15).select(*KEY, unit(F.col("resultant")).alias("c"))
    near = new.select("stream", "record_id", "vector").join(centre, "stream").select("stream", "record_id", "slot", F.round(dot(F.col("vector"), F.col("c")), 12).alias("cos")).where(F.col("cos") >= threshold)
    # the best of each task's leaves meets those of the others
    near = near.groupBy("stream", "record_id").agg(F.max_by("slot", F.struct("cos", -F.col("slot"))).alias("slot"))
    top = m.nodes.groupBy("stream").agg(F.max("node").alias("top"))
    placed = new.join(near, ["stream", "record_id"], "left").join(top, "stream", "left")
    rank = F.row_number().over(Window.partitionBy("stream", F.col("slot").isNull()).orderBy("record_id"))
    placed = cut(placed.withColumn("alone", F.col("slot").isNull()).withColumn("slot", F.coalesce("slot", F.coalesce("top", F.lit(-1)) + rank)))
    rows = placed.select("stream", "record_id", "slot", "vector", "value", "write_time", F.lit(None).cast("double").alias("last_used"), F.lit(0).cast("long").alias("reads"), "gain", F.lit(None).cast("long").alias("superseded_by"), "size")
    later = new.where("supersedes IS NOT NULL").groupBy("stream", F.col("supersedes").alias("record_id")).agg(F.max("record_id").alias("by"))
    every = m.records.unionByName(rows).join(later, ["stream", "record_id"], "left").withColumn("superseded_by", F.coalesce("by", "superseded_by"))
    young = placed.where("alone").select("stream", F.col("slot").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(True).alias("leaf"), F.lit(0).alias("pending"), F.lit(float("-inf")).alias("cooldown_until"), F.lit(0.0).alias("regret"))
    return m._replace(records=cut(every.select(m.records.columns)), nodes=cut(m.nodes.unionByName(young)))


def empty(spark: SparkSession) -> Memory:
    return Memory(*[spark.createDataFrame([], s) for s in (RECORD, NODE, COST)])


def advance(spark: SparkSession, root: str, version: int, writes: DataFrame, threshold: float, every: float, u: Upkeep) -> Memory:
    """Version ``version`` of the memory in ``root``: the one before, with a batch of writes, and a round of upkeep once ``every`` has passed since the last."""
    if version:
        before = Memory(*[spark.read.parquet(f"{root}/{version - 1}/{t}") for t in Memory._fields])
        last = spark.read.parquet(f"{root}/{version - 1}/clock").first().last
    else:
        before, last = empty(spark), None
    now = writes.agg(F.max("write_time")).first()[0]
    if now is None:
        m, last_after, report = before, last, None
    else:
        m, last_after, report = written(before, writes, threshold, now, u), now if last is None else last, None
        if last is not None and now >= last + every:
            (m, report), last_after = maintain(m, now, u), now
    for name, table in zip(Memory._fields, m):
        table.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    spark.createDataFrame([(last_after,)], "last double").write.mode("overwrite").parquet(f"{root}/{version}/clock")
    (report if report is not None else spark.createDataFrame([], REPORT)).write.mode("overwrite").parquet(f"{root}/{version}/report")
    return Memory(*[spark.read.parquet(f"{root}/{version}/{t}") for t in Memory._fields])


def live(writes: DataFrame, root: str, threshold: float, every: float, u: Upkeep) -> DataStreamWriter:
    """A writer that advances the memory in ``root`` by each micro-batch; the batch's number is the version."""
    return writes.writeStream.foreachBatch(lambda batch, k: advance(batch.sparkSession, root, k, batch, threshold, every, u))
