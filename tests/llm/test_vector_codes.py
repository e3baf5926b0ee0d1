"""Vector codes against plain integers, and the search against scanning every entry."""

import hashlib
import math
import random

import numpy as np
import pytest
from oracle import database, difference

from mnemolith.llm import queries
from mnemolith.llm.vector_codes import Book, code_report

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code string, error string, of string"


def made(n=300, dims=8, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randrange(10_000), [float(np.float32(rng.gauss(0, 0.2 + (k % 5 == 0)))) for _ in range(dims)], rng.choice([None, 0, 1, 2])) for k in range(n)]
    rows += [rows[7], rows[7], (None, [0.5] * dims, None), (20_000, [0.0] * dims, 1)]
    rows += [(1, None, 0), (2, [], 0), (3, [None] * dims, 1), (4, [math.nan] * dims, 1), (5, [math.inf] * dims, None), (30_000, [1.0] * (dims + 4), 2)]
    return [(*r, "a", "b", "c", "d") for r in rows]


def plain(rows, entries, rounds, parts=4, scale=1024):
    x = [(i, label, [math.floor(scale * float(np.float32(a))) for a in v]) for i, v, label, *_ in rows if v and all(a is not None and math.isfinite(a) for a in v)]
    x.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dims = len(x[0][2])
    x = [r for r in x if len(r[2]) == dims]
    w = dims // parts
    cut = lambda v, k: v[k * w : (k + 1) * w]
    books = [[cut(r[2], k) for r in x[:entries]] for k in range(parts)]
    d = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda v: [min((d(cut(v, k), c), e) for e, c in enumerate(books[k])) for k in range(parts)]
    for _ in range(rounds):
        found = [nearest(r[2]) for r in x]
        for k in range(parts):
            for e in range(len(books[k])):
                mine = [cut(r[2], k) for r, f in zip(x, found) if f[k][1] == e]
                if mine:
                    books[k][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [nearest(r[2]) for r in x]
    errors, by_label = [sum(p[0] for p in f) for f in found], {}
    for r, e in zip(x, errors):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{p[1]:02x}" for p in f), e, by_label[r[1]], sha) for r, f, e in zip(x, found, errors)), key=str)


@pytest.mark.parametrize("entries,rounds", [(256, 4), (16, 4), (5, 1)])
def test_against_plain_integers(spark, entries, rounds):
    rows = made()
    got = code_report(spark.createDataFrame(rows, SCHEMA).repartition(4), entries=entries, rounds=rounds).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, entries, rounds)


def test_few_rows_and_none(spark):
    few = made()[:3]
    assert sorted((tuple(r) for r in code_report(spark.createDataFrame(few, SCHEMA)).collect()), key=str) == plain(few, 256, 4)
    assert code_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert code_report(spark.createDataFrame([(1, None, 0, "", "", "", "")], SCHEMA)).count() == 0


def test_errors_are_said(spark):
    for v, said in (([1.0] * 6, "equal parts"), ([1e30] * 8, "a component beyond")):
        with pytest.raises(Exception, match=said):
            code_report(spark.createDataFrame([(1, v, 0, "", "", "", "")], SCHEMA)).collect()


@pytest.mark.parametrize("size", [3, 1 << 12, 1 << 25])
def test_search_finds_the_nearest_entry_of_all(size):
    """Small integers make many ties; large ones leave doubles."""
    rng = np.random.default_rng(4)
    entries, x = rng.integers(-size, size + 1, (40, 4)), rng.integers(-size, size + 1, (2000, 4))
    entries[7] = entries[30]
    book = Book(entries)
    apart = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in entries] for p in x], dtype=np.int64)
    for start in (np.zeros(len(x), np.int64), rng.integers(0, 40, len(x)), apart.argmin(axis=1)):
        code, best = book.nearest(x, start)
        assert (code == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(queries.op13_vector_codes(spark, sf), database(sf), queries.ORACLE["op13_vector_codes"]) == ""
