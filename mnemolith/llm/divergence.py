"""Source divergence audit: how far the sources of a language differ in their use of terms.

Systolic rotation: a group (lang, source) has a vector of term counts. The terms
of a language are cut into segments by hash, and its groups dealt to seats; the
vectors of a seat stay in their partition for all rounds. In each round of a
round-robin tournament (circle method) half of the seats send their compressed
vectors to the seat they meet, where both directions of every pair are worked
out. In the home round a seat's own groups meet each other and the language's
vector, from which a heap keeps each group's best terms. Sums over segments are
added by Spark, so neither a vector nor a heap is ever longer than a segment.

A zero count costs nothing: a resident holds its shares densely and knows the
sum of distances of all of them to any one value, from which a peer's few
non-zero terms are exchanged.

Defined results: null text, lang and source are ''; a group without kept terms
has count 0 everywhere; with no kept term in the language all pair values are 0
and there are no terms; repeated rows count as often as they come; an empty
table gives no rows; other columns are ignored. Arithmetic is in 64-bit
integers, exact up to 9e13 occurrences.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.llm.common import quoted
from mnemolith.session import bounded_batches, cut, remove, shared_dir

#: Terms are runs of these bytes of UTF-8: ASCII letters, and all that isn't ASCII.
_TERM = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
#: Terms and bytes of long terms that a counting task holds at once.
HELD, LONG = 1 << 18, 64 << 20
COUNTS = "lang string, source string, term binary, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"


def _rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = [None, *n]  # the first says that the group occurs
        for k in range(0, len(terms), 1 << 14):
            t = terms[k : k + (1 << 14)]
            yield pa.record_batch([pa.array([lang] * len(t), pa.string()), pa.array([source] * len(t), pa.string()), pa.array(t, pa.binary()), pa.array([n[x] for x in t], pa.int64()), pa.array([docs[x] for x in t], pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, added up within the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    terms = long = 0
    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, words = len(n), text.translate(_TERM).split()
            n.update(words)
            docs.update(distinct := set(words))
            terms += len(n) - before
            long += sum(len(w) for w in distinct if len(w) > 100)
            if terms > HELD or long > LONG:
                yield from _rows(held)
                held, terms, long = {}, 0, 0
    yield from _rows(held)


def shares(count: np.ndarray, total: int, terms: int, smooth: int) -> np.ndarray:
    """1 + floor(10^9 (count + smooth) / (total + smooth * terms)), by long division in two steps so that nothing overflows."""
    of = total + smooth * terms
    a = (count + smooth) * 100_000
    return 1 + a // of * 10_000 + a % of * 10_000 // of


def _pack(index: np.ndarray, count: np.ndarray) -> bytes:
    """A sparse vector, by ascending index, compressed."""
    step = np.diff(index, prepend=0).astype(np.int32)
    return zstandard.compress(step.tobytes() + count.astype(np.int64).tobytes(), 1)


def _unpack(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if raw is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = zstandard.decompress(raw)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.int32, n), dtype=np.int64), np.frombuffer(raw, np.int64, n, 4 * n)


def _vector(key, rows):
    lang, source, seg = (k.as_py() for k in key)
    index, n = rows["idx"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(index)
    return pa.table({"lang": [lang], "source": [source], "seg": pa.array([seg], pa.int32()), "n": [int(n.sum())], "vector": [_pack(index[order], n[order])]})


def _language(key, rows):
    """The language's own vector of a segment, with its terms."""
    lang, seg = (k.as_py() for k in key)
    order = np.argsort(rows["idx"].to_numpy())
    terms, n = rows["term"].take(pa.array(order)).to_pylist(), rows["n"].to_numpy()[order]
    return pa.table({"lang": [lang], "seg": pa.array([seg], pa.int32()), "n": [int(n.sum())], "size": [len(n)], "vector": [_pack(np.arange(len(n)), n)], "terms": [zstandard.compress(b"\0".join(terms), 1)]})


class _Resident:
    """A group at its seat: its shares of a segment's terms, and what sums of distances need."""

    def __init__(self, size: int, row: dict, smooth: int):
        self.source = row["source"]
        self.index, self.count = _unpack(row["vector"])
        zero = shares(np.zeros(1, np.int64), row["total"], row["v"], smooth)[0] if size else 0
        self.share = shares(self.count, row["total"], row["v"], smooth)
        self.zero = int(zero)
        self.dense = np.full(size, zero, np.int64)
        self.dense[self.index] = self.share
        self.sorted = np.sort(self.dense)
        self.sums = np.concatenate([[0], np.cumsum(self.sorted)])

    def all_to(self, x: int) -> int:
        """The sum of distances of all shares to ``x``."""
        k = int(np.searchsorted(self.sorted, x))
        return int(x * k - self.sums[k] + self.sums[-1] - self.sums[k] - x * (len(self.sorted) - k))

    def apart(self, other: _Resident) -> int:
        at = self.dense[other.index]
        return self.all_to(other.zero) - int(np.abs(at - other.zero).sum()) + int(np.abs(at - other.share).sum())


def _seated(rows: pa.Table, smooth: int) -> Iterator[_Resident]:
    for r in rows.to_pylist():
        yield _Resident(r["size"], r, smooth)


def _found(rows: list[tuple]) -> pa.Table:
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 5, types)], names=["lang", "source", "part", "item", "value"])


def _both(lang: str, a: _Resident, b: _Resident) -> list[tuple]:
    value = a.apart(b)
    return [(lang, a.source, "pair", b.source, value), (lang, b.source, "pair", a.source, value)]


def _meeting(smooth: int):
    def meet(key, hosts, guests):
        lang, held = key[0].as_py(), list(_seated(hosts, smooth))
        return _found([row for b in _seated(guests, smooth) for a in held for row in _both(lang, a, b)] if held else [])

    return meet


def _home(smooth: int, top: int):
    def meet(key, hosts, language):
        lang, held = key[0].as_py(), list(_seated(hosts, smooth))
        out = [row for k, a in enumerate(held) for b in held[k + 1 :] for row in _both(lang, a, b)]
        for row in language.to_pylist():  # one, or none where the language has no term here
            index, count = _unpack(row["vector"])
            q, terms = shares(count, row["total"], row["v"], smooth), zstandard.decompress(row["terms"]).split(b"\0")
            for a in held:
                gain = a.share - q[a.index]
                over = np.flatnonzero(gain > 0)
                if len(over) > top:  # all that may be among the best, ties included
                    over = over[gain[over] >= np.partition(gain[over], -top)[-top]]
                best = heapq.nsmallest(top, ((-int(gain[k]), terms[a.index[k]]) for k in over))
                out += [(lang, a.source, "term", t.decode("utf-8", "replace"), -g) for g, t in best]
        return _found(out)

    return meet


def partner(seat: Column, turn: int, seats: int) -> Column:
    """Whom a seat meets in a round of the circle method; ``seats`` is even, rounds go from 0 to ``seats`` - 2."""
    ring = seats - 1
    alone = turn * (ring + 1) // 2 % ring  # twice this is the round, so it meets the last seat
    return F.when(seat == ring, alone).when(seat == alone, ring).otherwise(F.pmod(turn - seat, F.lit(ring)))


def divergence(docs: DataFrame, least_docs: int = 30, smooth: int = 5, top: int = 50, segment: int = 1 << 16, residents: int = 32, seats: int = 8, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by distance, and the ``top`` terms over the language's share.

    ``segment``: terms of a segment on average; ``residents``: groups of a seat on average; ``seats``: at least so many seats.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    empty = lambda c: F.coalesce(F.col(quoted(c)), F.lit(""))
    plain = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).cast("binary").alias("text"))
    each = cut(plain.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = each.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs)
    kept = cut(kept.select("lang", "term", "n"))
    widest = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    segments = max(1, -(-widest // segment))
    place = F.row_number().over(Window.partitionBy("lang", "seg").orderBy("term")) - 1
    kept = cut(kept.withColumn("seg", F.pmod(F.xxhash64("term"), F.lit(segments)).cast("int")).withColumn("idx", place))

    counts = each.where("n > 0").join(kept.select("lang", "term", "seg", "idx"), ["lang", "term"])
    vectors = cut(counts.select("lang", "source", "seg", "idx", "n").groupBy("lang", "source", "seg").applyInArrow(_vector, "lang string, source string, seg int, n long, vector binary"))
    languages = cut(kept.groupBy("lang", "seg").applyInArrow(_language, "lang string, seg int, n long, size long, vector binary, terms binary"))
    totals = languages.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("size").alias("v"))
    # every group that occurs, at its seat, in every segment
    groups = cut(each.select("lang", "source").distinct())
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    seats = 2 * max(-(-seats // 2), -(-most // (2 * residents)))
    own = vectors.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(own, ["lang", "source"], "left").join(totals.select("lang", "v"), "lang", "left").withColumn("seat", F.pmod(F.xxhash64("source"), F.lit(seats)).cast("int"))
    groups = groups.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    seated = groups.join(vectors.drop("n"), ["lang", "source", "seg"], "left").join(languages.select("lang", "seg", "size"), ["lang", "seg"], "left")
    seated = seated.select("lang", "seg", "seat", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "size")], "vector")

    key = ["lang", "seg", "seat"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    home = cut(seated).repartition(parts, *key).persist(StorageLevel.DISK_ONLY)
    visitors = languages.drop("n", "size").join(totals, "lang").withColumn("seat", F.explode(F.sequence(F.lit(0), F.lit(seats - 1))))
    root = f"{shared_dir(spark)}/divergence_{uuid.uuid4().hex}"
    hosts = home.groupBy(*key)
    hosts.cogroup(visitors.groupBy(*key)).applyInArrow(_home(smooth, top), FOUND).write.parquet(f"{root}/turn=-1")
    for turn in range(seats - 1):
        other = partner(F.col("seat"), turn, seats)
        guests = home.where(F.col("seat") > other).withColumn("seat", other)
        hosts.cogroup(guests.groupBy(*key)).applyInArrow(_meeting(smooth), FOUND).write.parquet(f"{root}/turn={turn}")
    home.unpersist()
    found = spark.read.schema(FOUND).parquet(root).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    ranked = cut(found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)))
    remove(spark, root)
    return ranked
