"""Session helpers shared by the engine's parts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between Spark and its Python workers, where the session sets none.
BATCH_BYTES = 2 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: str = "8", app: str = "mnemolith") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores != "*" else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches are cut by bytes, not only by rows, so that long texts don't make large ones; a session's own setting stays."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(size))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors see.

    The setting is read from the session; only on one machine (tests) is a
    folder of our own taken where it is unset.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours, wherever Spark's file systems have it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
