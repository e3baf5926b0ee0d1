import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from mnemolith.llm.quality import _logistic, drop_bad, fit, scores


def test_scores(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    got = {r.doc_id: r.score for r in scores(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.8
    assert scores(odd, model).count() == odd.count()
    assert scores(empty, model).count() == drop_bad(empty, model, 0.5).count() == 0
    kept = drop_bad(docs, model, 0.5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
    # held-out labels don't matter
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert fit(docs, flipped) == model
    none = fit(docs, labels.limit(0))
    assert {r.score for r in scores(odd, none).collect()} == {0.5}


def test_whole_texts_teach(spark):
    # what tells good from bad stands after 10,000 characters of the same words
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(600)]
    common, kinds = words[:200], (words[200:400], words[400:])
    rows = [(i, " ".join(rng.choices(common, k=1500) + rng.choices(kinds[i % 2], k=1500)), i % 2) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.score for r in scores(docs, fit(docs, spark.createDataFrame([r[::2] for r in rows], "doc_id long, quality int"))).collect()}
    held = [(got[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((s >= 0.5) == (q == 1) for s, q in held) >= 0.9 * len(held)


def test_the_curve_converges():
    # a few outliers among well parted rows, where whole Newton steps swing until every score is 0
    r, y = np.random.default_rng(143), np.arange(200) % 2
    d = np.where(y == 1, r.normal(0.13, 0.06, 200), r.normal(-0.25, 0.08, 200))
    p = np.where(y == 1, r.normal(-0.8, 0.2, 200), r.normal(-2, 1.0, 200))
    d = np.clip(np.where(r.random(200) < 0.03, r.uniform(-0.9, 0.9, 200), d), -0.95, 0.95)
    p = np.where(r.random(200) < 0.05, r.uniform(-4.5, 0.2, 200), p)
    x = np.stack([np.ones(200), 5 * d, 5 * np.abs(d), p, p**2, np.minimum(0, p + 2) * 3], axis=1)
    w = _logistic(x, y.astype(float))
    assert ((x @ w > 0) == (y == 1)).mean() > 0.95
    z = x @ w
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-z))) - 1e-2 * w).max() < 1e-4  # the loss is flat there
