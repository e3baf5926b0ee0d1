import random
import zlib
from collections import Counter

from mnemolith.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards


def check(df, got, shards=16):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in rows if i is not None)
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}


def test_shards(docs, odd, empty):
    for df in (docs.repartition(5), odd, docs.limit(0), empty):
        for cell in (4096, 4):
            check(df, shuffle_into_shards(df, cell_rows=cell).collect())
    a, b = (sorted((r.doc_id, r.shard, r.slot) for r in shuffle_into_shards(docs, seed=s).collect()) for s in (1, 2))
    assert a != b and a == sorted((r.doc_id, r.shard, r.slot) for r in shuffle_into_shards(docs, seed=1).collect())


def test_uniform(spark):
    rng, n = random.Random(7), 20_000
    drawn = Counter(hypergeometric(rng, 5, 7, 4) for _ in range(n))
    for k, ways in ((0, 35), (1, 175), (2, 210), (3, 70), (4, 5)):
        assert abs(drawn[k] / n - ways / 495) < 0.015
    matrix = communication_matrix([1000, 1, 0, 57], 16, 3)
    assert [sum(m) for m in matrix] == [1000, 1, 0, 57]
    columns = [sum(c) for c in zip(*matrix)]
    assert max(columns) - min(columns) <= 1
    # neighbours don't stay together
    df = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    at = {r.doc_id: r.shard for r in shuffle_into_shards(df).collect()}
    same = sum(at[i] == at[i + 1] for i in range(3999)) / 3999
    assert abs(same - 1 / 16) < 0.02
