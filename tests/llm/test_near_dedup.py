"""The near-dedup stage against all pairs' exact similarity."""

import random
import zlib
from collections import Counter

from mnemolith.llm import simhash


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return x == y or bool(x and y) and len(x & y) >= 0.8 * len(x | y)


def made(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((30, 120, 600)))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(max(1, len(base) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k], "s", 1) for i, k in enumerate(order)]


def test_keeps_one_of_each_group(spark):
    rows = made()
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i][1], rows[j][1]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    wanted = {i for i in range(len(rows)) if root(i) == i}
    assert len(wanted) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, u int").repartition(4)
    got = simhash.drop_near(df)
    assert got.columns == df.columns
    found = {r.doc_id for r in got.collect()}
    assert wanted <= found
    # chances to miss a pair at 0.8 are about 1 in 5000 for a pair and round
    assert len(found - wanted) <= len(wanted) // 30


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"x{i}" for i in range(200)]
    rows = []
    for k in range(400):
        copy = list(base)
        copy[rng.randrange(200)] = f"y{k}"
        rows.append((k, " ".join(copy)))
    assert [r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_group_around_one_text(spark):
    rng = random.Random(7)
    base = [f"x{i}" for i in range(1000)]
    texts = []
    for k in range(400):
        copy = list(base)
        for i in rng.sample(range(1000), 20):
            copy[i] = f"y{k}_{i}"
        texts.append(" ".join(copy))
    # the copies are like the text in the middle only
    hub = " ".join(base)
    assert all(alike(hub, t) for t in texts) and not any(alike(texts[0], t) for t in texts[1:])
    rows = list(enumerate([*texts[:200], hub, *texts[200:]]))
    assert [r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_odd_rows(spark, odd, empty):
    rows = simhash.drop_near(odd).collect()
    assert simhash.drop_near(empty).count() == 0
    # two equal rows leave one; rows without words leave one, the smallest id
    assert sum(r.doc_id == 5 for r in rows) == 1
    assert [r.doc_id for r in rows if not (r.text or "").encode().split()] == [2]
    # ids 0, 1 and a null id hold the same words
    assert [r.doc_id for r in rows if shingles(r.text) == shingles("The same words here for all of them to see")] == [0]


def test_recall_on_a_table(spark):
    """All pairs of sf0.01 by exact similarity: the groups' members that the stage leaves out, and those it should have."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    by_size = sorted(sets, key=lambda i: len(sets[i]))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(by_size):
        a = sets[i]
        for j in by_size[k + 1 :]:
            b = sets[j]
            if len(a) < 0.8 * len(b):
                break
            both = len(a & b)
            if both >= 0.8 * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    wanted = {i for i in sets if root(i) != i}
    gone = set(sets) - {r.doc_id for r in simhash.drop_near(docs).collect()}
    assert wanted and gone <= wanted
    assert len(gone) >= 0.99 * len(wanted)


def edited(n=300, seed=11):
    """Near copies of one text with few to many edits: alike the text, alike each other only, or alike none."""
    rng = random.Random(seed)
    base = [f"x{i}" for i in range(150)]
    rows = [" ".join(base)]
    for k in range(n):
        copy = list(rng.choice(rows).split() if k % 5 == 0 else base)
        for i in rng.sample(range(150), rng.randrange(1, 16)):
            copy[i] = f"y{rng.randrange(40)}"
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_unlike_rows_of_a_large_group_make_few_pairs(spark, monkeypatch):
    rows = edited()
    made, cut = [], simhash.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["u", "v"]:
            made.append(out.count())
        return out

    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in rows:
        for j, b in rows[:i]:
            if alike(a, b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    wanted = [i for i, _ in rows if root(i) == i]
    assert 50 < len(wanted) < 250
    monkeypatch.setattr(simhash, "cut", counted)
    got = sorted(r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == wanted
    assert max(made) < 5 * len(rows)


def test_differences_lose_no_pair(spark):
    """Around any centre, all pairs alike of which one row at least isn't alike the centre."""
    sets = {i: sorted({zlib.crc32(x.encode()) for x in shingles(t)}) for i, t in edited(120, 3)}
    often = Counter(x for s in sets.values() for x in s)
    shared = [(i, len(s), sorted((x for x in s if often[x] > 1), key=lambda x: (often[x], x))) for i, s in sets.items()]

    def like(i, j):
        n = len(set(sets[i]) & set(sets[j]))
        return n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)

    for centre in (0, 17, 60):
        # some rows are of the centre's component already
        joined = {i for i in sets if i % 3 == 0 and like(i, centre)} | {centre}
        places = [(centre, -1, i, -1 if i in joined else i) for i in sets if i != centre]
        links, pairs = simhash.by_differences(spark.createDataFrame(places, "centre long, centre_root long, row long, root long"), spark.createDataFrame(shared, "row long, size int, hashes array<long>"), 0.8)
        assert {(r.u, r.v) for r in links.collect()} == {(i, centre) for i in sets if i not in joined and like(i, centre)}
        found = {frozenset((r.u, r.v)) for r in pairs.collect()}
        wanted = {frozenset((i, j)) for i in sets for j in sets if i < j and centre not in (i, j) and like(i, j) and not (like(i, centre) and like(j, centre)) and not (i in joined and j in joined)}
        assert wanted <= found and len(wanted) > 10
