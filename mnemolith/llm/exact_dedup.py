"""Exact dedup: two-pass Bloom filtering.

Pass one puts every normalised text's hash into a Bloom filter that keeps two
bits a slot (hit, hit again). A row all of whose slots were hit again may be
repeated; any other row is surely single. Pass two sends only the possibly
repeated rows into a shuffle; the rest pass straight through. False positives
cost a little shuffle and change no result.

The filter takes ``bits_per_row`` bits a row up to ``max_bits`` (32 MB when
packed, the proven bound of what is broadcast). Beyond that it fills up and
more rows shuffle, still with the same result.

Defined results: a null text counts as empty; white space runs count as one
space; equal rows (same id, same text) leave one row; a null id is the last
choice to stay; empty tables give empty results; other columns are carried by
``drop_copies`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolith.llm.common import BLANK, packed, quoted, text_or_empty, unpacked
from mnemolith.session import bounded_batches, cut

#: The filter is merged in so many pieces.
PIECES = 512


def text_digest(text_col: str = "text") -> Column:
    """Lower-case hex SHA-256 of the text with its white space runs made one space."""
    return F.sha2(F.regexp_replace(text_or_empty(text_col), BLANK, " "), 256)


def _slots(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Slots of each hash (rows: hash functions), by double hashing of its halves."""
    h = h.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(bits - 1) for i in range(hashes)])


def bloom_filter(hashes: DataFrame, rows: int, least: int, bits_per_row: int = 16, max_bits: int = 1 << 28, k: int = 3) -> tuple[bytes, int, int]:
    """(packed bits of slots hit ``least`` times (1 or 2), number of bits, hash functions) over the one column of ``hashes``."""
    bits = 1 << max(16, min(max_bits.bit_length() - 1, (rows * bits_per_row - 1).bit_length()))
    width = bits // PIECES

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the task's slots, each with whether it was hit more than once
        once = twice = np.empty(0, np.uint64)
        for b in batches:
            s, n = np.unique(_slots(b.column(0).to_numpy(zero_copy_only=False), bits, k), return_counts=True)
            again = np.concatenate([s[n > 1], np.intersect1d(once, s, assume_unique=True)])
            once, twice = np.union1d(once, s), np.union1d(twice, again)
        if len(once):
            many = np.isin(once, twice, assume_unique=True)
            piece = (once // np.uint64(width)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(piece)) + 1
            at = (once % np.uint64(width)).astype(np.int32)
            for p, a, m in zip(np.split(piece, cuts), np.split(at, cuts), np.split(many, cuts)):
                if dense := 5 * len(a) > width // 4:  # as bits, which bounds what a task sends
                    one, two = np.zeros(width, np.bool_), np.zeros(width, np.bool_)
                    one[a], two[a[m]] = True, True
                    a, m = np.packbits(one, bitorder="little"), np.packbits(two, bitorder="little")
                yield pa.record_batch([pa.array([int(p[0])], pa.int32()), pa.array([dense]), pa.array([a.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["piece", "dense", "slots", "again"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            for p, dense, s, m in zip(*(c.to_pylist() for c in b.columns)):
                x = seen.setdefault(p, np.zeros(width, np.uint8))
                if dense:
                    one, two = (np.unpackbits(np.frombuffer(z, np.uint8), bitorder="little") for z in (s, m))
                    np.minimum(x + one + two, 2, out=x)
                    continue
                slots = np.frombuffer(s, np.int32)
                x[slots] = np.minimum(x[slots] + 1 + np.frombuffer(m, np.bool_), 2)
        if seen:
            yield pa.record_batch([pa.array(list(seen), pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in seen.values()], pa.binary())], names=["piece", "bits"])

    pieces = hashes.mapInArrow(hits, "piece int, dense boolean, slots binary, again binary").repartition("piece").mapInArrow(merged, "piece int, bits binary")
    packed = bytearray(bits // 8)
    for r in pieces.collect():  # PIECES rows of at most max_bits / 8 / PIECES bytes
        packed[r.piece * width // 8 : (r.piece + 1) * width // 8] = r.bits
    return bytes(packed), bits, k


def in_filter(packed: bytes, bits: int, k: int, h: np.ndarray) -> np.ndarray:
    """Whether all slots of each hash are set."""
    filled = np.frombuffer(packed, np.uint8)
    out = np.ones(len(h), np.bool_)
    for s in _slots(h, bits, k):
        out &= ((filled[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1).astype(np.bool_)
    return out


def filter_test(spark, packed: bytes, bits: int, k: int):
    """A column function: whether a hash is in the filter, which is broadcast (``test.shared``)."""
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, bits, k, h.to_numpy()))

    test.shared = shared
    return test


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bloom) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    bounded_batches(docs.sparkSession)
    keyed = cut(docs.select(F.col(quoted(id_col)).alias("id"), F.unhex(text_digest(text_col)).alias("sha")).withColumns({"h": F.xxhash64("sha"), "row": F.monotonically_increasing_id()}))
    test = filter_test(docs.sparkSession, *bloom_filter(keyed.select("h"), max(1, keyed.count()), 2, **bloom))
    tested = keyed.withColumn("maybe", test("h"))
    alone = tested.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    maybe = tested.where("maybe").select("id", "sha", "row")
    # sums meet in the map tasks, so a hot text sends one row from each; the groups
    # are written, so that the join back shuffles both its sides and Spark can split a hot text's rows
    groups = cut(maybe.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("first"), F.count("*").alias("group_size")))
    found = maybe.join(groups, "sha").select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "sha")
    return alone.unionByName(found).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bloom) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; rows that are surely single don't shuffle."""
    bounded_batches(docs.sparkSession)
    rows = packed(docs, id=F.col(quoted(id_col)), sha=F.unhex(text_digest(text_col))).withColumn("h", F.xxhash64("sha"))
    keys = cut(rows.select("id", "sha", "h"))
    test = filter_test(docs.sparkSession, *bloom_filter(keys.select("h"), max(1, keys.count()), 2, **bloom))
    groups = keys.where(test("h")).groupBy("sha").agg(F.min("id").alias("keep"))
    tested = rows.withColumn("maybe", test("h"))
    # by text and id: the rows of a hot text go to many tasks, and one of them matches
    ours = tested.where("maybe").select("row", "id", F.col("sha").alias("own"))
    found = ours.join(groups, (F.col("own") == F.col("sha")) & F.col("id").eqNullSafe(F.col("keep"))).select("row", "sha").dropDuplicates(["sha"])
    return unpacked(tested.where(~F.col("maybe")).select("row").unionByName(found.select("row")), docs.columns)
