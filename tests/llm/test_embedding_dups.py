"""Near-duplicate vectors against all pairs: planted groups, odd rows, whole tables."""

import math
import random

import numpy as np
import pytest
from oracle import database, difference

from mnemolith.llm import queries
from mnemolith.llm.embedding_dups import _smallest, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cls string, links long, strip int"


def made(n=400, dims=24, seed=5):
    """Loose vectors, a hot vector, a chain whose ends don't link, a large group of near copies, scaled copies, odd rows."""
    rng = np.random.default_rng(seed)
    v = [rng.normal(size=dims) for _ in range(n)]
    hot = rng.normal(size=dims)
    v += [hot] * 80 + [hot * 3.0]
    a, b = rng.normal(size=dims), rng.normal(size=dims)
    v += [a * math.cos(k * 0.3) + b / np.linalg.norm(b) * np.linalg.norm(a) * math.sin(k * 0.3) for k in range(6)]
    core = rng.normal(size=dims)
    v += [core + rng.normal(size=dims) * 0.12 for _ in range(150)]
    rows = [(1000 + 7 * i % 5003, [float(np.float32(x)) for x in w]) for i, w in enumerate(v)]
    random.Random(seed).shuffle(rows)
    odd = [None, [], [0.0] * dims, [None] + [1.0] * (dims - 1), [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [1e38] * dims, [1e-38] * dims, [1.0] * (dims + 3), [1.0] * (dims + 3), [1.0]]
    rows += [(k, w) for k, w in enumerate(odd)] + [(3, [1.0] * dims), (None, rows[0][1]), (rows[5][0], rows[5][1]), (None, None)]
    return [(i, w, k % 3 or None, "c", 1, 2) for k, (i, w) in enumerate(rows)]


def plain(rows, least):
    x = []
    for _, w, *_ in rows:
        able = w and all(c is not None and math.isfinite(c) for c in w) and any(w)
        x.append(np.array(w, np.float32).astype(float) / np.linalg.norm(np.array(w, np.float32).astype(float)) if able else None)
    near = [[j for j in range(len(rows)) if j != i and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least] for i in range(len(rows))]
    root = {}
    for i in range(len(rows)):
        if i not in root:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            root |= dict.fromkeys(seen, min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
    return sorted(((rows[i][0], len(near[i]), root[i], rows[i][0] == root[i]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("given", [{}, {"rows": 64, "tile": 16}, {"rows": 100, "tile": 7, "least": 0.5}])
def test_against_all_pairs(spark, given):
    rows = made()
    got = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), **given).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == plain(rows, given.get("least", 0.95))


def test_empty_table(spark):
    got = near_vectors(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == 0
    assert near_vectors(spark.createDataFrame([(1, None, 1, "", 1, 1)], SCHEMA)).collect() == [(1, 0, 1, True)]


def test_smallest_reached():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randrange(1, 30)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(30))]
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        assert _smallest(n, a, b).tolist() == root


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert difference(queries.op12_embedding_dups(spark, sf), database(sf), queries.ORACLE["op12_embedding_dups"]) == ""
