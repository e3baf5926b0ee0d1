"""A tree of memory slots as joins: routed reads, splits by two means, merges of slots alike.

Leaves: (stream, parent, slot, centre); parents: (stream, parent, centre);
records: (stream, slot, record_id, vector, key, write_time, ...). All vectors
have length one. Every step works on all slots of all streams at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions.vector import TINY, dot, unit
from mnemolith.session import bounded_batches, cut


def _best(rows: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def centres(records: DataFrame, *by: str, vector: str = "vector") -> DataFrame:
    """(by..., centre): the direction of the sum of vectors; sums by dimension, so no group is gathered but for its few sums."""
    sums = records.select(*by, F.posexplode(vector).alias("dim", "x")).groupBy(*by, "dim").agg(F.sum("x").alias("s"))
    return sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("c")).select(*by, unit(F.transform("c", lambda z: z["s"])).alias("centre"))


def routed_reads(queries: DataFrame, parents: DataFrame, leaves: DataFrame, records: DataFrame, score: Column, route_k: int, child_k: int, top_k: int, least: float | None = None) -> DataFrame:
    """(query_id, record_id, score, rank): from the nearest parents to their nearest leaves to those leaves' best records.

    queries: (stream, query_id, vector as q, ...); ``score`` may use columns of queries and records. Records
    are what a read may see (visible, and of enough weight); ``least`` lets a read abstain.
    """
    near = queries.join(parents.select("stream", "parent", F.col("centre").alias("c")), "stream").withColumn("__s", F.round(dot(F.col("q"), F.col("c")), 12))
    near = _best(near, ["query_id"], route_k, F.desc("__s"), F.asc("parent")).drop("c", "__s")
    down = near.join(leaves.select("stream", "parent", "slot", F.col("centre").alias("c")), ["stream", "parent"]).withColumn("__s", F.round(dot(F.col("q"), F.col("c")), 12))
    down = _best(down, ["query_id", "parent"], child_k, F.desc("__s"), F.asc("slot")).drop("c", "__s")
    found = down.join(records, ["stream", "slot"]).withColumn("score", F.round(score, 12))
    found = found if least is None else found.where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("record_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "record_id", "score", "rank")


#: Bytes of all seeds up to which they are broadcast, and slots whose sums a task holds at a time.
SEEDS, HELD = 8 << 20, 1000


def _sums_of_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (no, id_hash, vector, c0, c1, n, x) to partial sums of each slot's two sides, with the number and mark of side 1."""
    held: dict[int, list] = {}

    def out() -> pa.RecordBatch:
        numbers = lambda i: pa.array([v[i] for v in held.values()], pa.list_(pa.float64()))
        return pa.record_batch([pa.array(list(held), pa.int64()), *map(numbers, range(4)), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(4, 8))], names=["no", "c0", "c1", "s0", "s1", "n", "x", "n_before", "x_before"])

    for b in batches:
        no = b.column(0).to_numpy()
        order = np.argsort(no, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(no[order])) + 1) if len(no) else ():
            part = b.take(pa.array(at))
            c = [None if x is None else np.array(x, float) for x in (part.column(3)[0].as_py(), part.column(4)[0].as_py())]
            have = part.filter(part.column(2).is_valid())
            vectors = have.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(have), -1) if len(have) else np.zeros((0, 0))
            side = np.zeros(len(have), np.bool_)
            if c[0] is not None and c[1] is not None and len(have):
                d0, d1 = np.zeros(len(have)), np.zeros(len(have))
                for k, column in enumerate(np.ascontiguousarray(vectors.T)):  # in the order in which ``dot`` adds
                    d0 += column * c[0][k]
                    d1 += column * c[1][k]
                side = (d1 > d0) | (np.isnan(d1) & ~np.isnan(d0))
            sums = [vectors[side == k].sum(axis=0) if (side == k).any() else None for k in (False, True)]
            n, x = int(side.sum()), int(np.bitwise_xor.reduce(have.column(1).to_numpy()[side]))
            if v := held.get(int(no[at[0]])):
                for k in (0, 1):
                    v[2 + k] = sums[k] if v[2 + k] is None else v[2 + k] if sums[k] is None else v[2 + k] + sums[k]
                v[4], v[5] = v[4] + n, v[5] ^ x
            else:
                held[int(no[at[0]])] = [*c, *sums, n, x, part.column(5)[0].as_py(), part.column(6)[0].as_py()]
        if len(held) >= HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _next_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums, those of a slot one after the other, to (no, c0, c1 as used, next0, next1, n, x, settled)."""
    names = ["no", "c0", "c1", "next0", "next1", "n", "x", "settled"]
    kinds = [pa.int64(), *[pa.list_(pa.float64())] * 4, pa.int64(), pa.int64(), pa.bool_()]

    def done(v: list) -> tuple:
        no, c0, c1, s0, s1, n, x, n_before, x_before = v
        u0, u1 = (None if s is None else s / max(float(np.sqrt((s * s).sum())), TINY) for s in (s0, s1))
        return no, c0, c1, u1 if u0 is None else u0, u0 if u1 is None else u1, n, x, (n, x) == (n_before, x_before)

    now = None
    for b in batches:
        rows = []
        for r in zip(*(c.to_pylist() for c in b.columns)):
            s = [None if y is None else np.array(y, float) for y in r[3:5]]
            if now and now[0] == r[0]:
                for k in (0, 1):
                    now[3 + k] = s[k] if now[3 + k] is None else now[3 + k] if s[k] is None else now[3 + k] + s[k]
                now[5], now[6] = now[5] + r[5], now[6] ^ r[6]
            else:
                if now:
                    rows.append(done(now))
                now = [*r[:3], *s, *r[5:]]
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    if now:
        yield pa.record_batch([pa.array([c], k) for c, k in zip(done(now), kinds)], names=names)


def two_means(records: DataFrame, rounds: int = 50) -> DataFrame:
    """(stream, slot, record_id, side): every slot's records parted in two by direction.

    Seeds: the record farthest from the slot's centre, and the one farthest from that. A round is one job over all
    slots that aren't settled: tasks part their records and send one sum a side; a slot is settled when none of its
    records changes sides. A slot of one record has one side.
    """
    key = ["stream", "slot"]
    bounded_batches(records.sparkSession)
    rows = cut(records.select(*key, "record_id", unit(F.col("vector")).alias("vector")))
    far = lambda to: F.min_by(F.col("vector"), F.struct(F.round(dot(F.col("vector"), F.col(to)), 12), F.col("record_id")))
    first = rows.join(centres(rows, *key), key).groupBy(*key).agg(far("centre").alias("c0"))
    seeds = rows.join(first, key).groupBy(*key).agg(F.first("c0").alias("c0"), far("c0").alias("c1"))
    slots = cut(seeds.select(F.monotonically_increasing_id().alias("no"), *key, "c0", "c1"))
    size = slots.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("c0")), F.lit(0)).alias("dims")).first()
    small = (lambda df: F.broadcast(df)) if size.n * max(1, size.dims) * 16 <= SEEDS else (lambda df: df)
    rows = cut(rows.join(small(slots.select("no", *key)), key).select("no", *key, "record_id", F.xxhash64("record_id").alias("id_hash"), "vector"))
    now = slots.select("no", "c0", "c1", F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("x"))
    last = None
    for k in range(rounds):
        met = rows.select("no", "id_hash", "vector").join(small(now), "no").select("no", "id_hash", "vector", "c0", "c1", "n", "x")
        sums = met.mapInArrow(_sums_of_sides, "no long, c0 array<double>, c1 array<double>, s0 array<double>, s1 array<double>, n long, x long, n_before long, x_before long")
        state = cut(sums.repartition("no").sortWithinPartitions("no").mapInArrow(_next_seeds, "no long, c0 array<double>, c1 array<double>, next0 array<double>, next1 array<double>, n long, x long, settled boolean"))
        more = k + 1 < rounds and not state.where("not settled").isEmpty()
        used = (state.where("settled") if more else state).select("no", "c0", "c1")
        last = used if last is None else last.unionByName(used)
        if not more:
            break
        now = state.where("not settled").select("no", F.col("next0").alias("c0"), F.col("next1").alias("c1"), "n", "x")
    side = F.when(dot(F.col("vector"), F.col("c1")) > dot(F.col("vector"), F.col("c0")), 1).otherwise(0)
    return cut(rows.join(small(last), "no").select(*key, "record_id", side.alias("side")))


def split_gains(records: DataFrame, sides: DataFrame, least_records: int = 4, least_gain: float = 0.05) -> DataFrame:
    """(stream, slot, before, after, accepted): mean regret to one and to two centres; a split must have enough records on both sides and gain enough."""
    key = ["stream", "slot"]
    rows = records.select(*key, "record_id", unit(F.col("vector")).alias("vector")).join(sides, [*key, "record_id"])
    each = rows.join(centres(rows, *key), key).join(centres(rows, *key, "side").withColumnRenamed("centre", "own"), [*key, "side"])
    out = each.groupBy(*key).agg(F.avg(1 - dot(F.col("vector"), F.col("centre"))).alias("before"), F.avg(1 - dot(F.col("vector"), F.col("own"))).alias("after"), F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    return out.select(*key, "before", "after", ((F.least("n0", "n1") >= least_records) & (F.col("before") - F.col("after") >= least_gain)).alias("accepted"))


def merge_pairs(slots: DataFrame, forbidden: DataFrame, similarity: float, rounds: int | None = None) -> DataFrame:
    """(stream, a, b, score): slots (stream, parent, slot, centre) of one parent that are ``similarity`` alike, best pairs first, each slot in one pair at most.

    ``forbidden``: (slot, other) that mustn't meet. A pair that is the best of both its slots is what the greedy order
    takes too; such pairs are taken in rounds until none is left, or in so many ``rounds``.
    """
    a, b = (slots.select("stream", "parent", F.col("slot").alias(n), F.col("centre").alias(f"c{n}")) for n in "ab")
    pairs = a.join(b, ["stream", "parent"]).where("a < b").withColumn("score", F.round(dot(F.col("ca"), F.col("cb")), 12)).where(F.col("score") >= similarity).select("stream", "a", "b", "score")
    barred = forbidden.select(F.least("slot", "other").alias("a"), F.greatest("slot", "other").alias("b")).distinct()
    left, taken = cut(pairs.join(barred, ["a", "b"], "left_anti").select("stream", "a", "b", "score")), None
    while rounds is None or rounds > 0:
        rounds = rounds if rounds is None else rounds - 1
        order = F.struct("score", -F.col("a"), -F.col("b"))
        ends = left.select("stream", F.explode(F.array("a", "b")).alias("slot"), "a", "b", "score").groupBy("stream", "slot").agg(F.max(order).alias("m")).select("stream", "slot", (-F.col("m.col2")).alias("a"), (-F.col("m.col3")).alias("b"), F.col("m.score").alias("score"))
        best = cut(ends.groupBy("stream", "a", "b", "score").count().where("count = 2").drop("count"))
        taken = best if taken is None else taken.unionByName(best)
        used = best.select("stream", F.explode(F.array("a", "b")).alias("slot"))
        for end in "ab":
            left = left.join(used.withColumnRenamed("slot", end), ["stream", end], "left_anti")
        left = cut(left.select("stream", "a", "b", "score"))
        if not left.limit(1).count():
            break
    return taken
