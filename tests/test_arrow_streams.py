"""The streaming source and sink: nothing is lost or repeated by a run that is cut off; the event log."""

import os
import time

from pyspark.sql import functions as F

from mnemolith.sources import arrow


def put(spark, folder, name, ids):
    """One file of the source, named once it is whole."""
    arrow.write_streams(spark.createDataFrame([(i, f"t{i}", 1) for i in ids], "id long, text string, other int").coalesce(1), f"{folder}-{name}")
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-{name}/part-00000.arrow", f"{folder}/{name}.arrow")


def run(spark, tmp, name="copy"):
    rows = spark.readStream.format("arrow_streams").option("columns", "id,text").load(f"{tmp}/in")
    q = rows.withColumn("half", F.col("id") % 2).writeStream.format("arrow_streams").option("checkpointLocation", f"{tmp}/state").queryName(name).trigger(availableNow=True).start(f"{tmp}/out")
    assert q.awaitTermination(120)
    return spark.read.format("arrow_streams").load(f"{tmp}/out")


def test_no_row_is_lost_or_comes_twice(spark, tmp_path):
    spark.dataSource.register(arrow.ArrowStreams)
    log = arrow.EventLog(str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        tmp = str(tmp_path)
        put(spark, f"{tmp}/in", "a", range(10))
        put(spark, f"{tmp}/in", "b", range(10, 15))
        assert sorted(tuple(r) for r in run(spark, tmp).collect()) == [(i, f"t{i}", i % 2) for i in range(15)]
        put(spark, f"{tmp}/in", "c", range(15, 20))
        assert run(spark, tmp).count() == 20
        # cut off after the sink's commit, before Spark noted the batch: it runs again
        os.remove(f"{tmp}/state/commits/1")
        [os.remove(f"{tmp}/state/commits/{f}") for f in os.listdir(f"{tmp}/state/commits") if f.startswith(".1")]
        assert run(spark, tmp).count() == 20
        # cut off while the files were named: the note isn't there, the files are
        os.remove(f"{tmp}/state/commits/1")
        [os.remove(f"{tmp}/state/commits/{f}") for f in os.listdir(f"{tmp}/state/commits") if f.startswith(".1")]
        os.remove(f"{tmp}/out/_done/00000001")
        assert run(spark, tmp).count() == 20
        put(spark, f"{tmp}/in", "d", [20])
        assert sorted(r.id for r in run(spark, tmp).collect()) == list(range(21))
        assert os.listdir(f"{tmp}/out/_tasks") == []
        for _ in range(50):
            said = arrow.events(spark, str(tmp_path / "log"))
            if said.where("kind = 'ended'").count() == 5:
                break
            time.sleep(0.2)
        rows = said.where("kind = 'progress' AND rows > 0").orderBy("number").collect()
        assert [(r.batch, r.rows) for r in rows] == [(0, 15), (1, 5), (1, 5), (1, 5), (2, 1)] and {r.name for r in rows} == {"copy"}
        assert said.where("kind = 'ended' AND error IS NULL").count() == said.where("kind = 'started'").count() == 5
    finally:
        spark.streams.removeListener(log)


def test_an_aborted_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(arrow.ArrowStreams)
    put(spark, f"{tmp_path}/in", "a", range(4))
    rows = spark.readStream.format("arrow_streams").load(f"{tmp_path}/in").withColumn("bad", F.when(F.col("id") == 3, F.raise_error(F.lit("stop")).cast("int")))
    q = rows.writeStream.format("arrow_streams").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    try:
        q.awaitTermination(120)
        raise AssertionError("it should fail")
    except Exception as said:
        assert "stop" in str(said)
    assert not [f for f in (os.listdir(f"{tmp_path}/out") if os.path.exists(f"{tmp_path}/out") else []) if f.endswith(".arrow")]
