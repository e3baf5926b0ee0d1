"""Each rule of a sample fires by itself; readers' branches and what they refuse; tables that don't agree with their manifest."""

import json

import pytest
from pyspark.sql import functions as F

from mnemolith.operators import attention
from mnemolith.sources import files, tables

SAMPLE = "sample_id string, sequence_id string, local_start int, local_end int, retrieval_position int, first_future_position int, horizon int, query array<double>, ids array<string>, ends array<int>, vectors array<array<double>>, absolute array<double>, total double, conditional array<double>"
SOUND = dict(sequence_id="s", local_start=40, local_end=50, retrieval_position=49, first_future_position=50, horizon=8, query=[1.0, 2.0], ids=["a", "b"], ends=[8, 16], vectors=[[1.0, 0.5], [0.0, 1.0]], absolute=[0.25, 0.5], total=0.75, conditional=[1 / 3, 2 / 3])
BROKEN = {
    "empty id": dict(sequence_id=""), "local range": dict(local_start=-1, retrieval_position=0, ends=[-5, -2]), "position outside": dict(retrieval_position=39), "future not after": dict(first_future_position=49), "horizon": dict(horizon=0),
    "no candidates": dict(ids=[], ends=[], vectors=[], absolute=[], total=0.0, conditional=[]), "ids repeat": dict(ids=["a", "a"]), "block in window": dict(ends=[8, 48]), "not finite": dict(query=[1.0, float("inf")]), "dimensions": dict(vectors=[[1.0, 0.5], [0.0]]),
    "mass per block": dict(conditional=[0.5, 0.25, 0.25]), "negative mass": dict(absolute=[-0.25, 1.0]), "total": dict(total=0.7), "not a distribution": dict(conditional=[0.5, 0.4]), "mass of nothing": dict(absolute=[0.0, 0.0], total=0.0),
}


def test_every_rule_fires_alone(spark):
    rows = [dict(SOUND, sample_id="sound"), dict(SOUND, sample_id="zero", absolute=[0.0, 0.0], total=0.0, conditional=[0.0, 0.0]), *(dict(SOUND, **change, sample_id=name) for name, change in BROKEN.items())]
    got = attention.sample_faults(spark.createDataFrame(rows, SAMPLE)).collect()
    assert sorted((r.sample_id, r.fault) for r in got) == sorted((n, n) for n in BROKEN)


def test_samples_without_mass_do_not_count(spark):
    """Shares of a sample whose mass is zero are zero, not undefined."""
    mass = spark.createDataFrame([(1, 0, 0, 0.0), (1, 0, 1, 0.0), (2, 0, 0, 0.25), (2, 0, 1, 0.75)], "sample_id long, future_index int, block_index int, mass double")
    target = attention.block_target(mass)
    assert {(r.sample_id, r.block_index): r.conditional for r in target.collect()} == {(1, 0): 0.0, (1, 1): 0.0, (2, 0): 0.25, (2, 1): 0.75}
    scores = spark.createDataFrame([(s, b, 0.0) for s in (1, 2) for b in (0, 1)], "sample_id long, block_index int, score double")
    assert attention.router_metrics(scores, target, 1).first().samples == 1


def test_local_readers(spark, tmp_path):
    rows = [{"text": "a\nb", "n": 1}, {"text": "", "n": 2}]
    (tmp_path / "x.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "splits.json").write_text(json.dumps({"train": rows, "test": rows[:1]}))
    (tmp_path / "x.txt").write_text("a\nb\n")
    spark.createDataFrame([("a", "train"), ("b", "test")], "text string, split string").write.partitionBy("split").parquet(str(tmp_path / "table"))
    read = lambda name, **how: sorted(tuple(r) for r in files.read_local(spark, str(tmp_path / name), **how).select("text").collect())
    assert read("x.jsonl") == read("list.json") == read("splits.json") == [("",), ("a\nb",)]
    assert read("splits.json", split="test") == [("a\nb",)]
    assert read("x.txt") == [("a\nb\n",)]
    assert read("table") == [("a",)] and read("table", split="test") == [("b",)]
    with pytest.raises(ValueError, match="no reader"):
        files.read_local(spark, "x.csv")


def test_a_bad_line_is_named(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"n": 1}\n\n{"n": \n')
    with pytest.raises(Exception, match="line 3"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "n long", ordered=True).collect()


def test_tables_that_do_not_agree(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, vector array<double>")
    path = str(tmp_path / "t")
    tables.create(df, path, {})
    assert tables.load(spark, path, {"vector": 2}).count() == 2
    with pytest.raises(Exception, match="already exists"):
        tables.create(df, path, {})
    with pytest.raises(ValueError, match="haven't 3 numbers"):
        tables.load(spark, path, {"vector": 3})
    df.limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="3 rows, not 2"):
        tables.load(spark, path)
    tables.write_manifest(spark, path, {"version": 0, "rows": 3, "columns": ["id"]}, "overwrite")
    with pytest.raises(ValueError, match="version 0.*columns"):
        tables.load(spark, path)


def test_metrics_of_finite_values_only(spark):
    from mnemolith.operators import retrieval

    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", float("inf"))], "k string, v double")
    got = {r[0]: tuple(r[1:]) for r in retrieval.finite_means(df, ["k"], "v").collect()}
    assert got["a"][0] == 1 and 1.0 in got["a"] and got.get("b", (0,))[0] == 0
    assert df.where(F.isnan("v")).count() == 1
