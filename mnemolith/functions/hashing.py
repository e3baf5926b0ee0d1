"""Deterministic buckets, orders and splits from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(key: Column, n: int = 10_000) -> Column:
    """The first 8 bytes of SHA-256, big-endian, modulo ``n``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def split_of(key: Column, train: int, validation: int) -> Column:
    """train, validation or test by the bucket out of 10,000."""
    b = bucket(key)
    return F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test")


def row_split(index: Column, seed: int = 13, name: str = "wildchat") -> Column:
    """90/5/5 by row index."""
    return split_of(F.concat(F.lit(f"{name}:{seed}:"), index.cast("string")), 9000, 500)


def source_split(path: Column, seed: int = 13) -> Column:
    """80/10/10 by the file's stem, so that files of one stem stay together."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return split_of(F.concat(F.lit(f"{seed}:"), stem), 8000, 1000)


def seeded_order(key: Column, seed: int) -> Column:
    """Sorts rows into a random order that depends on the seed and the key alone."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def grouped_split(df: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """Adds ``validation``: whole groups, the first round-half-even(n * fraction) by seeded order, 1 at least and n - 1 at most; none if there is one group."""
    groups = df.select(group).distinct().withColumn("o", seeded_order(F.col(group), seed))
    # the groups' ranks come from counts of a prefix of their order, not from one task that holds all
    groups = groups.withColumn("p", F.substring("o", 1, 4))
    sizes = groups.groupBy("p").count()
    before = sizes.select("p", (F.sum("count").over(Window.orderBy("p")) - F.col("count")).alias("before"))
    n = groups.agg(F.count("*").alias("n"))
    ranked = groups.join(before, "p").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("o")))
    taken = ranked.crossJoin(F.broadcast(n)).select(F.col(group), ((F.col("n") > 1) & (F.col("rank") <= F.least(F.col("n") - 1, F.greatest(F.lit(1), F.bround(F.col("n") * fraction).cast("long"))))).alias("validation"))
    return df.join(taken, group)
