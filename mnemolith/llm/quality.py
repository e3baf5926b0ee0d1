"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled
text. A text is compressed with either, in blocks so that long texts meet the
dictionary throughout; the difference of the compressed sizes over the larger
is the evidence. A logistic curve, fitted on labelled rows that built neither
dictionary, turns the two sizes per byte (difference, size, and their squares)
into a score from 0 to 1.

The fit takes a bounded sample of the labelled training rows: ``rows`` of each
label, in the order of a hash of their ids. Their texts are read whole: the
dictionaries are built of ``blocks`` blocks of each label at most, chosen by
hash from all places of the texts, and the curve is fitted to sizes of whole
texts, as scores are made. Scoring reads every whole text; it takes the text
alone.

Defined results: a null text counts as empty; an empty text gets the share of
good rows in the calibration sample; repeated rows get equal scores; an empty
table gives no rows; if the labels lack a class, every score is the share of
good rows (one half without any label); other columns are carried by
``drop_bad`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.llm.common import crc_mod, quoted, text_or_empty
from mnemolith.session import bounded_batches, cut

BLOCK, LEVEL, DICTIONARY = 2048, 3, 65536


def sizes_of(dictionaries: list[bytes]) -> Callable[[bytes], list[int]]:
    """Compressed bytes of a text with each dictionary, block by block."""
    packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in dictionaries]
    for_each = [p.compress for p in packers]

    def sizes(raw: bytes) -> list[int]:
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        return [sum(len(c(b)) for b in blocks) for c in for_each]

    return sizes


def _features(bad: np.ndarray, good: np.ndarray, n: np.ndarray) -> np.ndarray:
    d = (bad - good) / np.maximum(np.maximum(bad, good), 1)
    per_byte = np.log(np.maximum(good, 1) / np.maximum(n, 1))
    return np.stack([np.ones(len(d)), 5 * d, 5 * np.abs(d), per_byte, per_byte**2, np.minimum(0, per_byte + 2) * 3], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's steps, halved until the loss falls: whole steps swing ever wider where few rows lie near the curve's middle, and then all scores are 0 or all 1."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        while (then := loss(w + step)) > now and np.abs(step).max() >= 1e-8:
            step = step / 2
        if then > now:
            break
        w, now = w + step, then
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, blocks: int = 8192, parts: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: dictionaries, weights, and the share of good rows. Rows whose crc32(id) modulo ``parts`` is ``held`` aren't read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    known = labels.where("quality in (0, 1)").where(crc_mod("doc_id", parts) != held).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    sample = known.where("quality = 0").orderBy(order, "doc_id").limit(rows).unionByName(known.where("quality = 1").orderBy(order, "doc_id").limit(rows))
    share = known.agg(F.avg("quality")).first()[0]
    texts = cut(docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("text").alias("text")))
    model = {"share": 0.5 if share is None else float(share), "dictionaries": None, "weights": None}
    seen = [0, 0]
    role: list[tuple[int, bool]] = []
    for r in sorted(texts.select("doc_id", "quality").collect(), key=lambda r: r.doc_id):  # 2 * rows ids
        seen[r.quality] += 1
        role.append((r.doc_id, seen[r.quality] % 3 != 0))
    dealt = texts.join(F.broadcast(spark.createDataFrame(role, "doc_id long, builds boolean")), "doc_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, q, t in zip(*(c.to_pylist() for c in b.columns)):
                raw = t.encode("utf-8", "surrogatepass")
                got = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)] or [b""]
                yield pa.record_batch([pa.array([x] * len(got), k) for x, k in ((i, pa.int64()), (q, pa.int32()))] + [pa.array(range(len(got)), pa.int64()), pa.array(got, pa.binary())], names=["doc_id", "quality", "place", "block"])

    cutup = cut(dealt.where("builds").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text").mapInArrow(pieces, "doc_id long, quality int, place long, block binary"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one task for each label: blocks * BLOCK bytes at most
        chosen = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        got = [x[2] for x in chosen if x[2]]
        if sum(map(len, got)) >= 8192:
            yield pa.record_batch([pa.array([zstandard.train_dictionary(DICTIONARY, got).as_bytes()], pa.binary())], names=["dictionary"])

    built: list[bytes] = []
    for quality in (0, 1):
        chosen = cutup.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(blocks)
        built += [bytes(r.dictionary) for r in chosen.select("doc_id", "place", "block").coalesce(1).mapInArrow(train, "dictionary binary").collect()]
    rest = dealt.where("not builds AND text <> ''")
    enough = len(built) == 2 and all(n - n // 3 >= 10 for n in seen)
    if enough and {r[0] for r in rest.select("quality").distinct().collect()} == {0, 1}:
        model["dictionaries"] = built
        shared = spark.sparkContext.broadcast(model["dictionaries"])

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes = sizes_of(shared.value)
            for b in batches:
                raw = [t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
                three = np.array([[*sizes(t), len(t)] for t in raw], np.int64).reshape(-1, 3)
                yield pa.record_batch([b.column(0), b.column(1), *(pa.array(three[:, k]) for k in range(3))], names=["doc_id", "quality", "bad", "good", "n"])

        pairs = rest.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text").mapInArrow(measured, "doc_id long, quality int, bad long, good long, n long")
        pairs = sorted(pairs.collect(), key=lambda r: r.doc_id)
        x = np.array([[r.bad, r.good, r.n] for r in pairs], float)
        y = np.array([r.quality for r in pairs], float)
        # a class sampled below its share counts more
        weights = _logistic(_features(x[:, 0], x[:, 1], x[:, 2]), y)
        shift = np.log(model["share"] / (1 - model["share"])) - np.log(y.mean() / (1 - y.mean()))
        model["weights"] = [weights[0] + shift, *weights[1:].tolist()]
    return model


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = sizes_of(m["dictionaries"]) if m["dictionaries"] else None
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            s = np.full(len(raw), m["share"])
            if sizes and raw:
                x = np.array([[*sizes(t), len(t)] for t in raw], float)
                z = _features(x[:, 0], x[:, 1], x[:, 2]) @ m["weights"]
                s = np.where(x[:, 2] > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), s)
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(each, "id long, score double").withColumnRenamed("id", id_col)


def drop_bad(docs: DataFrame, model: dict, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their own columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        if not m["dictionaries"]:
            return pd.Series(np.full(len(texts), m["share"]))
        if not made:
            made.append(sizes_of(m["dictionaries"]))
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        x = np.array([[*made[0](t), len(t)] for t in raw], float).reshape(-1, 3)
        z = _features(x[:, 0], x[:, 1], x[:, 2]) @ m["weights"]
        return pd.Series(np.where(x[:, 2] > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), m["share"]))

    return docs.where(score(text_or_empty(text_col)) >= least)
