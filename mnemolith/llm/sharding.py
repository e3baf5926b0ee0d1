"""Sharding by a hypergeometric communication matrix; DataFrame functions only.

A uniform shuffle into shards of exact sizes, without a global sort:

1. The rows' ids, sizes and checksums (not the texts) are written once, with
   the input partition each came from.
2. How many rows each partition sends to each shard is drawn on the driver
   from the multivariate hypergeometric distribution, partition by partition,
   from the shards' remaining room: the counts that a uniform shuffle of all
   rows would give, so shard sizes come out exact.
3. Rows are permuted within their partition and dealt by the matrix.
4. After the exchange they are permuted again within the shard. A shard is cut
   into random cells of about ``cell_rows`` rows, each permuted by itself and
   laid behind the cells before, so that no task takes a whole shard.

Law ``rows``: counts of shards differ by one at most. What crosses the driver
is a row of the matrix for each input partition.

Defined results: a null text has size 1 and checksum 0; repeated and null ids
are rows like any other; an empty table gives no rows; other columns are
ignored. The same input files and seed give the same shards.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.llm.common import quoted, text_or_empty
from mnemolith.session import cut


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good: inversion outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    up = down = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    a = b = mode
    left = rng.random() - up
    while left > 0 and (a < high or b > low):
        if a < high:
            up *= (good - a) * (draws - a) / ((a + 1) * (bad - draws + a + 1))
            a += 1
            left -= up
            if left <= 0:
                return a
        if b > low:
            down *= b * (bad - draws + b) / ((good - b + 1) * (draws - b + 1))
            b -= 1
            left -= down
            if left <= 0:
                return b
    return mode


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; column sums differ by one at most."""
    rng, total = random.Random(seed), sum(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in rows:
        left, rest, counts = n, sum(room), []
        for s in range(shards):
            rest -= room[s]
            k = hypergeometric(rng, room[s], rest, left)
            counts.append(k)
            left -= k
        room = [r - k for r, k in zip(room, counts)]
        matrix.append(counts)
    return matrix


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 42, cell_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot (gapless from 0), grown_shard (null)."""
    text = text_or_empty(text_col)
    rows = cut(docs.select(F.col(quoted(id_col)).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    counts = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each input partition
    parts, total = sorted(counts), sum(counts.values())
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    upto = [[sum(m[: s + 1]) for s in range(shards)] for m in matrix]
    dealt = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"part": p, "upto": u} for p, u in zip(parts, upto)])), "array<struct<part:int,upto:array<bigint>>>")))

    def order(salt: int):
        return [F.xxhash64(F.lit(seed), F.lit(salt), "row"), F.col("row")]

    permuted = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order(1))))
    sent = permuted.join(dealt, "part").withColumn("shard", F.size(F.filter("upto", lambda u: u < F.col("rank"))))
    cells = max(1, -(-total // (shards * cell_rows)))
    sent = sent.select("id", "size", "text_crc32", "shard", "row", F.pmod(F.xxhash64(F.lit(seed), F.lit(2), "row"), F.lit(cells)).alias("cell"))
    placed = sent.withColumn("place", F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*order(3))) - 1)
    sizes = sent.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return placed.join(before, ["shard", "cell"]).select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
