"""Splits and merges of slots against plain code."""

import math
import random

from mnemolith.operators import hierarchy


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain_sides(vectors, rounds=50):
    ids = sorted(vectors)
    mean = unit([sum(c) for c in zip(*vectors.values())])
    far = lambda to: vectors[min(ids, key=lambda i: (round(dot(vectors[i], to), 12), i))]
    c = [far(mean)]
    c.append(far(c[0]))
    before = None
    for _ in range(rounds):
        side = {i: int(dot(vectors[i], c[1]) > dot(vectors[i], c[0])) for i in ids}
        if side == before:
            break
        before = side
        groups = [[vectors[i] for i in ids if side[i] == k] for k in (0, 1)]
        new = [unit([sum(x) for x in zip(*g)]) if g else None for g in groups]
        c = [new[0] or new[1], new[1] or new[0]]
    return before


def test_two_means_and_gains(spark):
    rng = random.Random(4)
    rows = []
    for slot in range(6):
        centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(1 + slot % 2)]
        for i in range(1 if slot == 5 else 30):
            c = centres[i % len(centres)]
            rows.append(("s", slot, slot * 100 + i, unit([x + rng.gauss(0, 0.2) for x in c])))
    df = spark.createDataFrame(rows, "stream string, slot int, record_id long, vector array<double>").repartition(3)
    sides = hierarchy.two_means(df)
    got = {r.record_id: r.side for r in sides.collect()}
    for slot in range(6):
        vectors = {r[2]: r[3] for r in rows if r[1] == slot}
        assert {i: got[i] for i in vectors} == plain_sides(vectors)
    gains = {r.slot: r for r in hierarchy.split_gains(df, sides).collect()}
    assert {s for s, r in gains.items() if r.accepted} == {1, 3}
    assert all(r.after <= r.before + 1e-9 for r in gains.values())


def test_rounds_stop_for_settled_slots_and_sum_in_tasks(spark):
    """No round sends a row for each number of each record, and many slots go by a join that isn't a broadcast."""
    rng = random.Random(6)
    rows = [("s", slot, slot * 100 + i, [rng.gauss(0, 1) for _ in range(4)]) for slot in range(5) for i in range(40)]
    df = spark.createDataFrame([*rows, ("s", 9, 999, None)], "stream string, slot int, record_id long, vector array<double>").repartition(4)
    plans, once, held = [], hierarchy.cut, hierarchy.SEEDS
    try:
        hierarchy.cut = lambda x: plans.append(x._jdf.queryExecution().optimizedPlan().toString()) or once(x)
        hierarchy.SEEDS = 0
        got = {r.record_id: r.side for r in hierarchy.two_means(df).collect()}
    finally:
        hierarchy.cut, hierarchy.SEEDS = once, held
    assert not any("Generate" in p for p in plans[3:])
    for slot in range(5):
        vectors = {r[2]: unit(r[3]) for r in rows if r[1] == slot}
        assert {i: got[i] for i in vectors} == plain_sides(vectors)


def test_merges_are_greedy(spark):
    rng = random.Random(9)
    slots = [("s", k % 3, k, unit([rng.gauss(1, 1) for _ in range(5)])) for k in range(40)]
    forbidden = {(a, b) for a in range(40) for b in range(a) if (a * b) % 7 == 3}
    pairs = sorted(((round(dot(x[3], y[3]), 12), -x[2], -y[2]) for x in slots for y in slots if x[2] < y[2] and x[1] == y[1] and (y[2], x[2]) not in forbidden), reverse=True)
    used, wanted = set(), set()
    for score, a, b in pairs:
        if score >= 0.3 and not {-a, -b} & used:
            used |= {-a, -b}
            wanted.add((-a, -b))
    df = spark.createDataFrame(slots, "stream string, parent int, slot int, centre array<double>")
    barred = spark.createDataFrame(sorted(forbidden), "slot int, other int")
    assert {(r.a, r.b) for r in hierarchy.merge_pairs(df, barred, 0.3).collect()} == wanted
