"""The given tables in the engine's own shapes."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from mnemolith.functions.vector import dot, softmax

#: Vectors of a sample: the first KEYS are its past, the rest its future.
SAMPLE, KEYS, BLOCK = 50, 40, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_order(key: Column, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sequence_id"), n.cast("long").alias("n_tokens"))


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, layer, head, future_index, key_position, p): softmax of dot products, two layers of two heads of 16 dimensions."""
    v = vectors(spark, sf_dir).select(F.floor(F.col("id") / SAMPLE).alias("sample_id"), (F.col("id") % SAMPLE).cast("int").alias("pos"), "vector")
    keys, futures = v.where(F.col("pos") < KEYS), v.where(F.col("pos") >= KEYS)
    pairs = futures.alias("f").join(keys.alias("k"), "sample_id").select("sample_id", (F.col("f.pos") - KEYS).alias("future_index"), F.col("k.pos").alias("key_position"), F.col("f.vector").alias("a"), F.col("k.vector").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("lh"))
    part = lambda c: F.slice(c, F.col("lh") * 16 + 1, F.lit(16))
    scored = pairs.select("sample_id", F.floor(F.col("lh") / 2).cast("int").alias("layer"), (F.col("lh") % 2).alias("head"), "future_index", "key_position", (dot(part("a"), part("b")) / 4).alias("s"))
    return scored.withColumn("p", softmax(F.col("s"), "sample_id", "layer", "head", "future_index")).drop("s")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, cand_index, start_position, end_position, score, mass): blocks of a sample's past, scored by its first future vector."""
    from mnemolith.operators.attention import block_mass, block_target

    v = vectors(spark, sf_dir).select(F.floor(F.col("id") / SAMPLE).alias("sample_id"), (F.col("id") % SAMPLE).cast("int").alias("pos"), "vector")
    query = v.where(F.col("pos") == KEYS).select("sample_id", F.col("vector").alias("q"))
    scored = v.where(F.col("pos") < KEYS).join(query, "sample_id").groupBy("sample_id", F.floor(F.col("pos") / BLOCK).cast("int").alias("cand_index")).agg(F.avg(dot(F.col("q"), F.col("vector"))).alias("score"))
    mass = block_target(block_mass(attention(spark, sf_dir), BLOCK)).select("sample_id", F.col("block_index").alias("cand_index"), F.col("conditional").alias("mass"))
    return scored.join(mass, ["sample_id", "cand_index"]).select("sample_id", "cand_index", (F.col("cand_index") * BLOCK).alias("start_position"), ((F.col("cand_index") + 1) * BLOCK).alias("end_position"), "score", "mass")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a memory's records: time is the id, a label's write supersedes the label's one before."""
    from mnemolith.functions.vector import unit
    from mnemolith.operators.temporal import supersede_by_group

    v = vectors(spark, sf_dir)
    r = v.select(F.lit("s").alias("stream"), F.col("id").alias("record_id"), F.col("label").alias("slot"), F.col("label").alias("conflict_group"), F.col("id").cast("double").alias("write_time"), unit(F.col("vector")).alias("vector"), F.col("vector").cast("array<double>").alias("key"), F.col("vector").cast("array<double>").alias("value"))
    return supersede_by_group(r)


def memory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of all vectors in streams of a thousand, and a read after every tenth."""
    v = vectors(spark, sf_dir).select(F.concat(F.lit("s"), F.floor(F.col("id") / 1000).cast("string")).alias("stream"), F.lit(0).alias("layer"), F.lit("g").alias("grp"), (F.col("id") * 2).alias("seq"), F.lit("write").alias("op"), F.col("id").cast("double").alias("time"), F.col("vector").cast("array<double>").alias("vector"), F.col("id").cast("string").alias("source"), F.col("label").cast("string").alias("conflict_group"), F.lit(4).alias("top_k"))
    reads = v.where(F.col("seq") % 20 == 0).withColumns({"op": F.lit("read"), "seq": F.col("seq") + 1})
    return v.unionByName(reads)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in order: (key, pos, x)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.row_number().over(w) - 1).alias("pos"), F.col("value").alias("x"))


__all__ = ["attention", "by_order", "candidates", "memory_events", "records", "sequences", "steps", "table", "vectors"]
