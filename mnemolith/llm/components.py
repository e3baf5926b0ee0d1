"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the edges, written to the
checkpoint folder; edges never reach the driver. It ends when a round changes
nothing, after O(log^2 n) rounds. Joins are merge joins: a round's small tables
would otherwise each be held by the driver as a broadcast. A round has as many
tasks as its edges need, so that few edges don't make many small files. No more
edges than one task of a round takes are joined up in that task at once: each
round is a dozen plans, which the driver holds, makes code for and schedules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.llm.common import tasks_for
from mnemolith.session import cut

#: Tasks that a node's rows are dealt to at most, and edges that one task takes.
SALTS, EDGES = 16, 100_000


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) of a few to (node, root)."""
    above: dict = {}
    kind = None

    def top(x):
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = top(u), top(v)
            if u != v:
                above[max(u, v)] = min(u, v)
    if above:
        yield pa.record_batch([pa.array(list(above), kind), pa.array([top(x) for x in list(above)], kind)], names=["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = EDGES) -> DataFrame:
    """(node, root) for every node of an edge between different nodes that isn't its own root; root is the smallest node reachable.

    Up to ``few`` edges, a fixed number, are joined up in one task.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    if mark[0] <= few:
        kind = now.schema["u"].dataType.simpleString()
        return cut(now.coalesce(1).mapInArrow(_joined_up, f"node {kind}, root {kind}"))
    while mark[0]:
        tasks = tasks_for(edges.sparkSession, mark[0], EDGES)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        # a hub's rows are dealt to several tasks
        salts = min(SALTS, -(-mark[0] // EDGES))
        least = least.select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
        salted = both.where("v > u").withColumn("s", F.pmod(F.hash("v"), F.lit(salts)))
        large = salted.join(least.hint("merge"), ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).where("u <> v").distinct().coalesce(tasks))
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return r.n, r.x
