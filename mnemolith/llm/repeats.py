"""Substring dedup: words covered by a window that starts in an earlier document too.

The reference of a document is every document with a smaller id, so suffix
automata of it would be several times the corpus and every document would
have to pass through every shard of them; see the README for figures. This
operator finds the same spans with work in proportion to the corpus:

1. Anchors: the least hash of the ``anchor``-word grams in each window. Equal
   windows have equal anchors, and neighbouring windows mostly share theirs,
   so about one word in five starts one. Anchors met in two documents go into
   a Bloom filter of bounded size, which is broadcast.
2. Windows whose anchor is in the filter are hashed and aggregated to the
   smallest document each starts in. A filter that is too full lets more
   windows through and changes no result.
3. Those windows meet their smallest document again in an ordinary join, whose
   large partitions Spark splits; covered documents (found by a second filter)
   join their spans, and all others pass straight through.

Windows are equal if their 64-bit hashes are: of n windows about n / 2**64 * n
/ 2 pairs collide by chance (0.0006 pairs over the 0.5 GB check table).

Defined results: a null text has no words; a null id counts as larger than any
other; rows that share an id are judged each by its own text, and don't cover
each other; repeated rows give repeated rows; an empty table gives no rows;
other columns are carried by ``without_repeats`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.llm.common import packed, quoted, text_or_empty
from mnemolith.llm.exact_dedup import bloom_filter, filter_test, in_filter
from mnemolith.session import bounded_batches, cut

ANCHOR = 6
#: Bytes whose words are hashed at once.
CHUNK = 1 << 20
LAST_ID = (1 << 63) - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _factors(n: int) -> np.ndarray:
    """Odd numbers that look random, one for each place in a word."""
    x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


#: Beyond so many bytes a word's factors repeat, times the next odd number.
PLACES = 1 << 12
FACTORS = _factors(PLACES)
BLANKS = np.zeros(256, np.bool_)
BLANKS[[0x20, *range(9, 14)]] = True
BLANK_BYTE = re.compile(rb"[\x20\x09-\x0D]")


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts without nulls, end to end, and where each begins (and the last ends)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of all texts, how many each text has).

    A word's hash is the mixed sum of its bytes times the factors of their places. Bytes are worked on ``CHUNK`` at a time,
    so that a long text takes little beside its hashes.
    """
    raw, ends = _text_bytes(texts)
    out, counts, a = [], np.zeros(len(texts), np.int64), 0
    view = memoryview(raw)
    while a < len(raw):
        b = min(a + CHUNK, len(raw))
        if b < len(raw):  # to where no word goes on
            blank = BLANK_BYTE.search(view, b)
            b = min(blank.start() if blank else len(raw), int(ends[np.searchsorted(ends, b)]))
        part = raw[a:b]
        within = ~BLANKS[part]
        begins = within.copy()
        begins[1:] &= ~within[:-1]
        cuts = ends[np.searchsorted(ends, a) : np.searchsorted(ends, b)] - a
        begins[cuts] = within[cuts]
        at, starts = np.flatnonzero(within), np.flatnonzero(begins)
        if len(starts):
            place = at - np.repeat(starts, np.diff(np.append(np.searchsorted(at, starts), len(at))))
            factor = FACTORS[place & (PLACES - 1)]
            if place.max() >= PLACES:
                factor = factor * ((place // PLACES).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            out.append(_mixed(np.add.reduceat((part[at].astype(np.uint64) + np.uint64(1)) * factor, np.searchsorted(at, starts))))
            counts += np.diff(np.searchsorted(starts + a, ends))
        a = b
    return np.concatenate(out) if out else np.empty(0, np.uint64), counts


def _sums(w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[at + j]
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _grams(w: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words."""
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[j : len(w) - n + 1 + j]
    return _mixed(h)


def _anchors(w: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window the least gram hash in it."""
    g, n = _grams(w, anchor), len(w) - window + 1
    least = g[:n].copy()
    for j in range(1, window - anchor + 1):
        np.minimum(least, g[j : j + n], out=least)
    return least


class _Windows:
    """The windows of a batch of texts, worked out for all of them at once; one that would lie across two texts isn't one."""

    def __init__(self, texts: pa.Array, window: int, anchor: int):
        self.texts, self.window = len(texts), window
        self.hashes, lengths = word_hashes(texts)
        starts = len(self.hashes) - window + 1
        if starts < 1:
            self.at = self.text = self.run = np.empty(0, np.int64)
            self.anchors = np.empty(0, np.uint64)
            return
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        text = np.repeat(np.arange(len(texts)), lengths)[:starts]
        self.at = np.flatnonzero(np.arange(starts) + window <= self.first[text + 1])  # starts of windows
        self.text = text[self.at]
        least = _anchors(self.hashes, window, anchor)[self.at]
        # neighbouring windows mostly share their anchor
        new = np.ones(len(least), np.bool_)
        new[1:] = (least[1:] != least[:-1]) | (self.text[1:] != self.text[:-1])
        self.run = np.cumsum(new) - 1
        self.anchors, self.owner = least[new], self.text[new]

    def offsets(self, text: np.ndarray) -> pa.Array:
        """Where each text's values begin, of values whose text is given in order."""
        return pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.texts))]).astype(np.int32))

    def grams(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at so many places."""
        if 3 * len(at) > len(self.hashes):
            return _grams(self.hashes, self.window)[at]
        return _mixed(_sums(self.hashes, at, self.window))


def _covering_starts(docs: DataFrame, shared_ids: bool, window: int, anchor: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = keyed(docs, shared_ids, id_col, text_col).select("doc", "tag", "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Windows(b.column(2), window, anchor)
            if len(x.at):
                yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(x.offsets(x.owner), pa.array(x.anchors.view(np.int64)))], names=["doc", "tag", "anchors"])

    met = rows.mapInArrow(anchors, "doc long, tag long, anchors array<long>").select("doc", F.explode("anchors").alias("anchor"))
    repeated = cut(met.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("anchor"))
    packed, bits, k = bloom_filter(repeated, max(1, repeated.count()), 1)
    shared = spark.sparkContext.broadcast(packed)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Windows(b.column(2), window, anchor)
            some = np.flatnonzero(in_filter(shared.value, bits, k, x.anchors)[x.run]) if len(x.at) else x.at
            if len(some):
                at, text = x.at[some], x.text[some]
                offsets = x.offsets(text)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (x.grams(at).view(np.int64), (at - x.first[text]).astype(np.int32))]
                yield pa.record_batch([b.column(0), b.column(1), *lists], names=["doc", "tag", "hashes", "starts"])

    found = rows.mapInArrow(windows, "doc long, tag long, hashes array<long>, starts array<int>")
    # the tag moves only where ids are shared
    key = ["doc", "tag"] if shared_ids else ["doc"]
    each = found.select(*key, F.explode(F.arrays_zip("hashes", "starts")).alias("w")).select(*key, F.col("w.hashes").alias("h"), F.col("w.starts").alias("start"))
    # written, so that the join shuffles both its sides and Spark can split a hot window's rows
    firsts = cut(found.select("doc", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h", "first"))
    starts = each.join(firsts, "h").where("doc > first").groupBy(*key).agg(F.collect_list("start").alias("starts"))
    return starts.select("doc", F.col("tag") if "tag" in key else F.lit(0).cast("long").alias("tag"), "starts")


def _shared_ids(docs: DataFrame, id_col: str) -> bool:
    ids = docs.select(F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(LAST_ID)).alias("doc"))
    return ids.groupBy("doc").count().where("count > 1").limit(1).count() > 0


def keyed(docs: DataFrame, shared_ids: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (as ``row``) with doc (the id), tag (tells rows apart that share an id) and text without nulls."""
    text = text_or_empty(text_col)
    return packed(docs, doc=F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(LAST_ID)), tag=F.xxhash64(text) if shared_ids else F.lit(0).cast("long"), text=text)


def covered(n: int, starts: list[int] | None, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    if starts is not None and len(starts):
        s = np.unique(np.asarray(starts))
        np.add.at(edge, s, 1)
        np.add.at(edge, s + window, -1)
    return np.cumsum(edge[:n]) > 0


def _with_starts(docs: DataFrame, window: int, anchor: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their starts, and the rows that have none."""
    shared_ids = _shared_ids(docs, id_col)
    starts = cut(_covering_starts(docs, shared_ids, window, anchor, id_col, text_col))
    test = filter_test(docs.sparkSession, *bloom_filter(starts.select(F.xxhash64("doc")), max(1, starts.count()), 1))
    rows = keyed(docs, shared_ids, id_col, text_col).withColumn("maybe", test(F.xxhash64("doc")))
    return rows.where("maybe").drop("maybe").join(starts, ["doc", "tag"], "left"), rows.where("not maybe").drop("maybe").withColumn("starts", F.lit(None).cast("array<int>"))


def repeat_report(docs: DataFrame, window: int = 13, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = t.encode("utf-8", "surrogatepass").split()
                gone = covered(len(words), starts, window)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if starts else words
                out.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                n, r, s = zip(*out)
                yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s)], names=["id", "n_words", "n_removed", "kept_sha256"])

    touched, rest = _with_starts(docs, window, anchor, id_col, text_col)
    columns = [F.col(f"row.{quoted(id_col)}").cast("long").alias("id"), F.col("text"), F.col("starts")]
    return touched.select(columns).unionByName(rest.select(columns)).mapInArrow(digest, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, window: int, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the covered words (and the white space after each) cut from their texts; ``length_col``, if there, follows."""

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, starts):
            if s is None or not len(s):
                out.append(t)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            at = [m.start() for m in WORD.finditer(raw)]
            gone = covered(len(at), s, window).tolist()
            ends = [*at[1:], len(raw)]
            out.append((raw[: at[0]] + b"".join(raw[a:e] for a, e, g in zip(at, ends, gone) if not g)).decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    touched, rest = _with_starts(docs, window, anchor, id_col, text_col)
    cleaned = touched.withColumn("new", F.when(F.col("starts").isNull(), F.col(f"row.{quoted(text_col)}")).otherwise(cut_out("text", "starts")))

    def value(c: str):
        if c == text_col:
            return F.col("new").alias(c)
        if c == length_col:
            return F.when(F.col("starts").isNull(), F.col(f"row.{quoted(c)}")).otherwise(F.length("new")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"row.{quoted(c)}").alias(c)

    return cleaned.select([value(c) for c in docs.columns]).unionByName(rest.select([F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns]))
