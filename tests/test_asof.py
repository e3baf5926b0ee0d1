"""Reads as of a time against a tree that is built anew for each query."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mnemolith.operators import asof

RECORDS = "stream string, record_id long, slot long, write_time double, superseded_at double, vector array<double>"
#: Two levels in a, three in b with a leaf beside a subtree, and a root that is a leaf.
NODES = [("a", 1, None), ("a", 2, None), ("a", 11, 1), ("a", 12, 1), ("a", 21, 2), ("a", 22, 2), ("b", 1, None), ("b", 5, None), ("b", 11, 1), ("b", 12, 1), ("b", 121, 12), ("b", 122, 12)]
LEAVES = {"a": [11, 12, 21, 22], "b": [5, 11, 121, 122]}


def made(seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        s = rng.choice("ab")
        w = float(rng.randrange(40))
        rows.append((s, k, rng.choice(LEAVES[s]), w, w + rng.randrange(1, 20) if rng.random() < 0.5 else None, [rng.gauss(0, 1) for _ in range(4)]))
    queries = [(rng.choice("ab"), k, [rng.gauss(0, 1) for _ in range(4)], float(rng.randrange(-2, 45))) for k in range(25)]
    return rows, queries


def length(v):
    return math.sqrt(sum(x * x for x in v))


def plain(rows, query, route_k, child_k, recency, decay):
    """The tree at the query's time, and the leaves that it comes to."""
    stream, _, q, t = query
    there = [r for r in rows if r[0] == stream and r[3] <= t and (r[4] is None or r[4] > t)]

    def state(node):  # sum, mass, last write
        children = [n for s, n, p in NODES if s == stream and p == node]
        if not children:
            mine = [r for r in there if r[2] == node]
            w = [math.exp(decay * r[3]) for r in mine]
            seen = [r[3] for r in rows if r[0] == stream and r[2] == node and r[3] <= t]
            return ([sum(a * x for a, x in zip(w, c)) for c in zip(*(r[5] for r in mine))] if mine else None, sum(w), max(seen, default=None))
        parts = [x for x in map(state, children)]
        live = [x for x in parts if x[0]]
        total = [sum(x[1] * x[0][k] / length(x[0]) for x in live) for k in range(4)] if live else None
        return total, sum(x[1] for x in live), max((x[2] for x in parts if x[2] is not None), default=None)

    def score(node):
        total, _, last = state(node)
        if not total or length(total) < 1e-12:
            return None
        return round(sum(a * b for a, b in zip(total, q)) / (length(total) * length(q)) + (recency / (1 + max(0, t - last)) if recency else 0), 9)

    def best(nodes, k):
        scored = [(-s, n) for n in nodes if (s := score(n)) is not None]
        return [n for _, n in sorted(scored)[:k]]

    out, todo, k = [], [[n for s, n, p in NODES if s == stream and p is None]], route_k
    while todo:
        later = []
        for some in todo:
            for n in best(some, k):
                children = [c for s, c, p in NODES if s == stream and p == n]
                later += [children] if children else []
                out += [] if children else [n]
        todo, k = later, child_k
    return sorted(out), there


@pytest.mark.parametrize("route_k,child_k,recency,decay", [(2, 2, 0.0, 0.0), (1, 1, 0.0, 0.05), (1, 2, 0.7, 0.0)])
def test_against_a_tree_for_each_query(spark, route_k, child_k, recency, decay):
    rows, queries = made()
    r, n = spark.createDataFrame(rows, RECORDS), spark.createDataFrame(NODES, "stream string, node long, parent long")
    q = spark.createDataFrame(queries, "stream string, query_id long, q array<double>, as_of double")
    weight = F.exp(decay * F.col("write_time"))
    got = asof.routed_slots(q, r, n, weight, route_k, child_k, recency).collect()
    for query in queries:
        assert sorted(x.slot for x in got if x.query_id == query[1]) == plain(rows, query, route_k, child_k, recency, decay)[0], query
    dot = F.aggregate(F.zip_with("q", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    reads = asof.asof_reads(q, r, n, weight, dot, route_k, child_k, 3, least=0.0, recency=recency).collect()
    hits = {}
    for query in queries:
        slots, there = plain(rows, query, route_k, child_k, recency, decay)
        scored = sorted(((round(sum(a * b for a, b in zip(query[2], x[5])), 9), x[1]) for x in there if x[2] in slots), reverse=True)
        wanted = [i for s, i in scored if s >= 0][:3]
        assert [x.record_id for x in sorted((x for x in reads if x.query_id == query[1]), key=lambda x: x["rank"])] == wanted
        for s in slots:
            hits.setdefault((query[0], s), []).append((query[3], query[1], any(x[1] in wanted and x[2] == s for x in there)))
    # averages over a slot's reads in order
    found = spark.createDataFrame(reads)
    used = {(x.stream, x.slot): x.used for x in asof.usage(asof.routed_slots(q, r, n, weight, route_k, child_k, recency), found, q, 0.3).collect()}
    for key, each in hits.items():
        e = 0.0
        for _, _, hit in sorted(each):
            e = 0.7 * e + 0.3 * hit
        assert abs(used[key] - e) < 1e-12


def test_pruned_up_to_the_root(spark):
    n = spark.createDataFrame(NODES, "stream string, node long, parent long")
    r = spark.createDataFrame([("b", 121), ("b", 121), ("a", 99)], "stream string, slot long")
    assert sorted((x.stream, x.node) for x in asof.kept_nodes(n, r).collect()) == [("b", 1), ("b", 12), ("b", 121)]
    assert asof.kept_nodes(n, r.where("false")).count() == 0


def test_no_nodes_and_no_records(spark):
    rows, queries = made()
    q = spark.createDataFrame(queries, "stream string, query_id long, q array<double>, as_of double")
    n, r = spark.createDataFrame([], "stream string, node long, parent long"), spark.createDataFrame(rows, RECORDS)
    assert asof.routed_slots(q, r, n, F.lit(1.0), 1, 1).count() == 0
    n = spark.createDataFrame(NODES, "stream string, node long, parent long")
    assert asof.routed_slots(q, r.where("false"), n, F.lit(1.0), 1, 1).count() == 0
