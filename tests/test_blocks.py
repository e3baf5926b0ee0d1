"""The block store: what is read, versions, runs that failed, compaction."""

import pytest
from pyspark.sql import functions as F

from mnemolith.sources.blocks import BlockStore


def batch(spark, ids, payload):
    return spark.createDataFrame([(f"k{i:04d}", payload, i) for i in ids], "block_id string, payload string, n long")


def files_of(df):
    return {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in df.inputFiles()}


def test_a_lookup_opens_only_files_that_can_hold_its_keys(spark, tmp_path):
    s = BlockStore(spark, str(tmp_path / "store"), "block_id")
    s.upsert(batch(spark, range(1000), "a"), 10)
    s.upsert(batch(spark, range(100, 140), "b"), 2)
    assert s.index().count() == 12
    got = s.lookup(["k0005", "k0120", "k0999", "nothing"])
    assert len(files_of(got)) == 4  # three files of the first version, one of the second
    assert {r.block_id: r.payload for r in got.collect()} == {"k0005": "a", "k0120": "b", "k0999": "a"}
    assert len(files_of(s.lookup(["k0000"]))) == 1
    assert s.lookup(["zzz"]).count() == s.lookup([]).count() == 0
    many = spark.createDataFrame([(f"k{i:04d}",) for i in range(95, 105)] + [("k0100",), (None,)], "block_id string")
    assert {r.block_id: r.payload for r in s.lookup(many).collect()} == {f"k{i:04d}": "b" if i >= 100 else "a" for i in range(95, 105)}


def test_latest_equals_a_dictionary_over_many_versions(spark, tmp_path):
    s, held = BlockStore(spark, str(tmp_path / "store"), "block_id"), {}
    for v, ids in enumerate([range(0, 50), range(20, 30), range(25, 80), [3]]):
        assert s.upsert(batch(spark, ids, str(v)), 3) == v
        held |= {f"k{i:04d}": str(v) for i in ids}
    same = lambda df: {r.block_id: r.payload for r in df.collect()} == held and df.count() == len(held)
    assert same(s.latest())
    s.compact(4)
    assert same(s.latest()) and s.index().count() <= 4
    assert "Exchange" not in s.latest()._jdf.queryExecution().toString()  # one version: nothing is shuffled
    assert s.vacuum() == 4 and same(s.latest())
    s.upsert(batch(spark, [3, 900], "x"))
    held |= {"k0003": "x", "k0900": "x"}
    assert same(s.latest()) and same(s.lookup(list(held)))


def test_a_version_without_its_index_is_not_there(spark, tmp_path):
    s = BlockStore(spark, str(tmp_path / "store"), "block_id")
    s.upsert(batch(spark, range(5), "a"))
    batch(spark, range(3), "lost").write.parquet(f"{tmp_path}/store/data/0-1")  # a run that ended before its index
    assert {r.payload for r in s.latest().collect()} == {"a"}
    s.upsert(batch(spark, [1], "b"))
    assert sorted(r.payload for r in s.latest().collect()) == ["a"] * 4 + ["b"]


@pytest.mark.parametrize("n", [0, 1])
def test_small_stores(spark, tmp_path, n):
    s = BlockStore(spark, str(tmp_path / "store"), "block_id")
    s.upsert(batch(spark, range(n), "a"))
    s.upsert(batch(spark, range(3), "b"))
    assert s.latest().where(F.col("payload") == "b").count() == 3
