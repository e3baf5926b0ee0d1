"""Grouped consolidation of a window of writes into slots, as joins over all streams at once.

Slots: (stream, slot, key, value, n, age), a mean key and value of ``n`` writes.
Writes: (stream, id, key, value), distinct ids that give their order. Every write
is judged against the slots as they were: one whose nearest slot (by cosine) is
above the threshold is merged into it, all of a slot's at once; the others take
places of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions.vector import dot, unit
from mnemolith.session import cut


def nearest(writes: DataFrame, slots: DataFrame) -> DataFrame:
    """(stream, id, slot, score) of each write whose stream has slots; ties go to the lower slot. Each task keeps a write's best before the shuffle."""
    a = writes.select("stream", "id", unit(F.col("key")).alias("a"))
    b = slots.select("stream", "slot", unit(F.col("key")).alias("b"))
    near = a.join(b, "stream").select("stream", "id", "slot", F.round(dot(F.col("a"), F.col("b")), 12).alias("score"))
    best = near.groupBy("stream", "id").agg(F.max(F.struct("score", (-F.col("slot")).alias("slot"))).alias("m"))
    return best.select("stream", "id", (-F.col("m.slot")).alias("slot"), F.col("m.score").alias("score"))


def _sums(rows: DataFrame, column: str) -> DataFrame:
    """(stream, slot, column): sums of an array column by position, as an array."""
    sums = rows.select("stream", "slot", F.posexplode(column).alias("i", "x")).groupBy("stream", "slot", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    return sums.groupBy("stream", "slot").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias(column))


def consolidated(slots: DataFrame, writes: DataFrame, threshold: float, capacity: int) -> DataFrame:
    """The slots after a window: (stream, slot, key, value, n, age, fate), fate one of kept, merged, taken.

    Places are taken in the order: free ones by number, slots that weren't touched from the oldest, touched ones by number;
    after the last by number again, so that of several writes to a place the last stays.
    """
    near = cut(writes.join(nearest(writes, slots), ["stream", "id"], "left"))
    known = near.where(F.col("score") > threshold)
    added = known.groupBy("stream", "slot").agg(F.count("*").alias("m"))
    for c in ("key", "value"):
        added = added.join(_sums(known, c).withColumnRenamed(c, f"{c}_sum"), ["stream", "slot"])
    mean = lambda c: F.when(F.col("m").isNull(), F.transform(c, lambda x: x.cast("double"))).otherwise(F.zip_with(c, f"{c}_sum", lambda x, s: (x.cast("double") * F.col("n") + s) / (F.col("n") + F.col("m"))))
    touched = F.col("m").isNotNull()
    merged = cut(slots.join(added, ["stream", "slot"], "left").select("stream", "slot", mean("key").alias("key"), mean("value").alias("value"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.when(touched, 0).otherwise(F.col("age") + 1).alias("age"), touched.alias("touched")))
    novel = near.where(F.col("score").isNull() | (F.col("score") <= threshold))
    r = F.row_number().over(Window.partitionBy("stream").orderBy("id")) - 1
    novel = novel.withColumn("r", r).select("stream", "key", "value", "r", (F.col("r") % capacity).alias("at"), (F.col("r") < capacity).alias("first"))
    # all places of the streams that have novel writes
    places = novel.select("stream").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(capacity - 1)))).withColumn("slot", F.col("slot").cast("long"))
    places = places.join(merged.select("stream", "slot", "age", "touched"), ["stream", "slot"], "left")
    kind: Column = F.when(F.col("touched").isNull(), 0).when(~F.col("touched"), 1).otherwise(2)
    order = Window.partitionBy("stream").orderBy(kind, F.when(kind == 1, -F.col("age")).otherwise(0), "slot")
    places = places.select("stream", "slot", (F.row_number().over(order) - 1).alias("at"))
    taken = novel.where("first").join(places, ["stream", "at"]).select("stream", "slot", "r", "key", "value").unionByName(novel.where("NOT first").select("stream", F.col("at").alias("slot"), "r", "key", "value"))
    taken = taken.groupBy("stream", "slot").agg(F.max_by(F.struct("key", "value"), "r").alias("w"))
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    new = taken.select("stream", "slot", double("w.key").alias("key"), double("w.value").alias("value"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("age"), F.lit("taken").alias("fate"))
    kept = merged.join(taken.select("stream", "slot"), ["stream", "slot"], "left_anti").select("stream", "slot", "key", "value", F.col("n").cast("long").alias("n"), F.col("age").cast("long").alias("age"), F.when(F.col("touched"), "merged").otherwise("kept").alias("fate"))
    return kept.unionByName(new)
