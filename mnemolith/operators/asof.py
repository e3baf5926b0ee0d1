"""Reads of a tree of slots as of each query's own time.

Records: (stream, record_id, slot, write_time, superseded_at, vector, ...).
Nodes: (stream, node, parent), parent null at a root; a record's slot is a node
without children. A record is there from its write until it is superseded. A
leaf's centre at a time is the direction of the sum of what is there, weighted;
a parent's is that of its children's centres, weighted by their masses.

No tree is built for a query. What a record adds to its leaf, and takes away
when it is superseded, are changes at two times; a leaf's changes and the reads
that ask for it run through a task in order of time, beside one running sum. A
leaf's change is one of its parent too, so the next level up gets its changes
from the pass below, and each level of the tree is one pass. Reads then go down
from the roots: of each level the best nodes, then their children.

Weights may fall with age by a common rate, which changes no direction: a
record's weight counts as of one fixed time. A node with nothing in it at the
time is not routed to. Order of equal times: changes, then reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.session import bounded_batches, cut

PASS = "stream string, node long, parent long, time double, vector array<double>, mass double, n int, query_id long"
#: A mass this small is nothing (a sum that should be zero).
TINY = 1e-12


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes and reads of nodes in order: each read's score, and each change as one of the parent.

    A row with a query_id is a read, whose vector is the query. Out: a read's score in ``mass`` and the node's
    last write in ``time`` (no row where nothing is there); a change's parent in ``node``.
    """
    at, total, mass, n, last, given = None, np.zeros(0), 0.0, 0, -np.inf, np.zeros(0)
    for b in batches:
        out: list[tuple] = []
        for stream, node, parent, time, vector, m, k, query in zip(*(c.to_pylist() for c in b.columns)):
            v = np.array(vector)
            if at != (stream, node):
                at, total, mass, n, last, given = (stream, node), np.zeros(len(v)), 0.0, 0, -np.inf, np.zeros(len(v))
            if query is not None:
                length = np.linalg.norm(total)
                if n and mass > TINY and length > TINY:
                    out.append((stream, node, parent, last, None, float(total @ v / (length * np.linalg.norm(v))), 0, query))
                continue
            total, mass, n = total + v, mass + m, n + k
            if k > 0:
                last = max(last, time)
            if n == 0:
                total, mass = np.zeros(len(v)), 0.0
            if parent is not None:
                # a parent's sum is of unit centres times masses
                length = np.linalg.norm(total)
                now = total / length * mass if n and length > TINY else np.zeros(len(v))
                out.append((stream, parent, None, time, (now - given).tolist(), m, k, None))
                given = now
        if out:
            types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in PASS.split(", ")])


def _pass(rows: DataFrame) -> DataFrame:
    ordered = rows.repartition("stream", "node").sortWithinPartitions("stream", "node", "time", F.col("query_id").isNotNull(), F.desc("n"))
    return ordered.select(*[x.split()[0] for x in PASS.split(", ")]).mapInArrow(_runs, PASS)


def changes(records: DataFrame, nodes: DataFrame, weight: Column) -> DataFrame:
    """The leaves' changes: each record comes at its write and goes when it is superseded."""
    v = F.transform("vector", lambda x: x.cast("double") * F.col("w"))
    each = records.withColumn("w", weight).select("stream", F.col("slot").cast("long").alias("node"), "write_time", "superseded_at", v.alias("vector"), "w")
    come = each.select("stream", "node", F.col("write_time").cast("double").alias("time"), "vector", F.col("w").alias("mass"), F.lit(1).alias("n"))
    go = each.where("superseded_at IS NOT NULL").select("stream", "node", F.col("superseded_at").cast("double").alias("time"), F.transform("vector", lambda x: -x).alias("vector"), (-F.col("w")).alias("mass"), F.lit(-1).alias("n"))
    return _placed(come.unionByName(go), nodes)


def _placed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    own = nodes.select("stream", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"))
    return rows.drop("parent", "query_id").join(own, ["stream", "node"]).withColumn("query_id", F.lit(None).cast("long"))


def levels(nodes: DataFrame) -> DataFrame:
    """(stream, node, parent, height): 0 for nodes without children, else one more than the highest child."""
    rows = nodes.sparkSession.sql(
        """WITH RECURSIVE up(stream, node, height) AS (
             SELECT stream, node, 0 FROM {nodes} WHERE NOT EXISTS (SELECT 1 FROM {nodes} c WHERE c.stream = {nodes}.stream AND c.parent = {nodes}.node)
             UNION ALL SELECT n.stream, n.parent, u.height + 1 FROM up u JOIN {nodes} n ON n.stream = u.stream AND n.node = u.node WHERE n.parent IS NOT NULL)
           SELECT stream, node, max(height) AS height FROM up GROUP BY stream, node""",
        nodes=nodes,
    )
    return nodes.select("stream", "node", "parent").join(rows, ["stream", "node"])


def routed_slots(queries: DataFrame, records: DataFrame, nodes: DataFrame, weight: Column, route_k: int, child_k: int, recency: float = 0.0) -> DataFrame:
    """(stream, query_id, slot, score): the leaves that each query (stream, query_id, q, as_of) comes to. Ids are whole numbers."""
    bounded_batches(queries.sparkSession)
    tree = cut(levels(nodes))
    top = tree.agg(F.max("height")).first()[0]
    if top is None:
        return queries.select("stream", "query_id", F.lit(None).cast("long").alias("slot"), F.lit(0.0).alias("score")).where("false")
    # up: every node's changes, a level at a time; a parent of children of several heights gets all of them
    up = cut(changes(records, tree, weight))
    every = [up]
    for _ in range(top):
        up = cut(_placed(_pass(up.where("parent IS NOT NULL")).where("query_id IS NULL"), tree))
        every.append(up)
    whole = every[0]
    for e in every[1:]:
        whole = whole.unionByName(e)
    whole = whole.withColumn("parent", F.lit(None).cast("long"))  # nothing more goes up
    asked = queries.select("stream", F.col("query_id").cast("long").alias("query_id"), F.transform("q", lambda x: x.cast("double")).alias("vector"), F.col("as_of").cast("double").alias("time"))
    asked = cut(asked.withColumns({"mass": F.lit(0.0), "n": F.lit(0)}))
    reads, k, by = asked.join(tree.where("parent IS NULL").select("stream", "node", "height"), "stream"), route_k, ["stream", "query_id"]
    found = None
    for _ in range(top + 1):
        reads = cut(reads.withColumn("parent", F.lit(None).cast("long")))
        near = reads.select("stream", "node").distinct()
        scored = _pass(whole.join(near, ["stream", "node"], "left_semi").unionByName(reads.drop("height", "via"))).where("query_id IS NOT NULL").select("stream", "node", "query_id", F.col("mass").alias("score"), F.col("time").alias("last"))
        scored = scored.join(reads.select("stream", "node", "query_id", "time", "height", *(["via"] if "via" in reads.columns else [])), ["stream", "node", "query_id"])
        if recency:
            scored = scored.withColumn("score", F.col("score") + recency / (1 + F.greatest(F.lit(0.0), F.col("time") - F.col("last"))))
        scored = scored.withColumn("score", F.round("score", 12))
        w = Window.partitionBy(*by).orderBy(F.desc("score"), "node")
        best = cut(scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r"))
        leaves = best.where("height = 0").select("stream", "query_id", F.col("node").alias("slot"), "score")
        found = leaves if found is None else found.unionByName(leaves)
        down = best.where("height > 0").select("stream", F.col("node").alias("via"), "query_id")
        children = tree.where("parent IS NOT NULL").select("stream", "node", F.col("parent").alias("via"), "height")
        reads, k, by = asked.join(down, ["stream", "query_id"]).join(children, ["stream", "via"]), child_k, ["stream", "query_id", "via"]
    return found


def asof_reads(queries: DataFrame, records: DataFrame, nodes: DataFrame, weight: Column, score: Column, route_k: int = 4, child_k: int = 4, top_k: int = 4, least: float | None = None, enough: Column | None = None, recency: float = 0.0) -> DataFrame:
    """(stream, query_id, record_id, slot, score, rank): what each query finds among the records that were there at its ``as_of``.

    ``score`` and ``enough`` (whether a record weighs enough) may use columns of queries and records.
    """
    slots = routed_slots(queries, records, nodes, weight, route_k, child_k, recency).select("stream", "query_id", "slot")
    there = (F.col("write_time") <= F.col("as_of")) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("as_of")))
    found = slots.join(queries, ["stream", "query_id"]).join(records, ["stream", "slot"]).where(there if enough is None else there & enough)
    found = found.select("stream", "query_id", "record_id", "slot", F.round(score, 12).alias("score"))
    found = found if least is None else found.where(F.col("score") >= least)
    w = Window.partitionBy("stream", "query_id").orderBy(F.desc("score"), F.desc("record_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def average_of(rows: DataFrame, value: str, rate: float, by: list[str], *order: str) -> DataFrame:
    """(by..., value): the exponential moving average of a column after its rows in order, from 0: each row counts rate * (1 - rate) ** (rows after it)."""
    later = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])) - 1
    return rows.select(*by, (rate * F.pow(F.lit(1 - rate), later) * F.col(value).cast("double")).alias(value)).groupBy(*by).agg(F.sum(value).alias(value))


def usage(routed: DataFrame, found: DataFrame, queries: DataFrame, rate: float) -> DataFrame:
    """(stream, slot, used): the moving average, over a slot's reads in order of time, of whether a read took one of its records."""
    took = found.select("stream", "query_id", "slot").distinct().withColumn("hit", F.lit(True))
    each = routed.join(took, ["stream", "query_id", "slot"], "left").join(queries.select("stream", "query_id", "as_of"), ["stream", "query_id"])
    return average_of(each.withColumn("used", F.coalesce("hit", F.lit(False)).cast("int")), "used", rate, ["stream", "slot"], "as_of", "query_id")


def kept_nodes(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """The nodes that stay once those without records, and parents left without children, are gone: the slots of records and all above them."""
    return nodes.sparkSession.sql(
        """WITH RECURSIVE up(stream, node, parent) AS (
             SELECT n.stream, n.node, n.parent FROM {nodes} n LEFT SEMI JOIN {records} r ON r.stream = n.stream AND r.slot = n.node
             UNION ALL SELECT n.stream, n.node, n.parent FROM up u JOIN {nodes} n ON n.stream = u.stream AND n.node = u.parent)
           SELECT DISTINCT stream, node, parent FROM up""",
        nodes=nodes,
        records=records,
    )
