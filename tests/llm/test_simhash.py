import random
import re

import xxhash

from mnemolith.llm import components
from mnemolith.llm.components import connected_components
from mnemolith.llm.simhash import links, near_components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {n: find(n) for n in nodes}


def test_components(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r.doc_id, brute_print(r.text)) for r in df.collect()]
        prints = sorted({p for _, p in rows})
        root = roots(prints, [(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 2])
        first = {}
        for i, p in rows:
            if i is not None:
                first[root[p]] = min(i, first.get(root[p], i))
        want = sorted(((i, f"{p:016x}", first.get(root[p])) for i, p in rows), key=str)
        assert sorted((tuple(r) for r in near_components(df).collect()), key=str) == want
    assert near_components(empty).count() == 0


def test_crowded_keys_lose_no_link(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)} | set(base)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    df = spark.createDataFrame(signed, "fp long")
    for crowd in (0, 8, 1000):
        got = [tuple(r) for r in links(df, 2, 8, crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in links(df, 1, 4, 8).collect()} == {(a, b) for a, b in want if bin((a ^ b) & (1 << 64) - 1).count("1") == 1}


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (200, 100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 200: 100}


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """Few edges are joined up in three jobs' plans; rounds give the same for as many as there are."""
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(400 + i, 401 + i) for i in range(30)]
    want = roots(sorted({x for e in edges for x in e}), edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    made, once = [], components.cut
    monkeypatch.setattr(components, "cut", lambda x: made.append(1) or once(x))
    by = {few: {r.node: r.root for r in connected_components(df, few=few).collect()} for few in (components.EDGES, 0)}
    assert by[0] == by[components.EDGES] == {n: r for n, r in want.items() if n != r}
    made.clear()
    connected_components(df)
    assert len(made) == 2
    assert connected_components(df.where("a < 0")).count() == 0
