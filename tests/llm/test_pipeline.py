"""The corpus pipeline's stages, each on its own input."""

import hashlib
import re

from test_repeats import WORD, brute

import corpus_pipeline
from mnemolith.llm import quality, simhash

SF = "/root/testdata/sf0.001"


def stay(docs):
    """The smallest id of each group that links of 0.8 or more between sets of five words lead to, from all pairs."""
    sets = {}
    for r in docs.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in ids}


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if name != "pack":
            assert docs.columns == columns
            assert docs.dtypes == before.dtypes
        if name == "quality":
            model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in quality.scores(before, model).where(f"score >= {corpus_pipeline.LEAST}").collect()}
        if name == "exact_dedup":
            first = {}
            for r in sorted(before.collect(), key=lambda r: r.doc_id):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(first.values())
            assert docs.count() < before.count()
        if name == "near_dedup":
            assert simhash.drop_near(docs).count() == docs.count()
            assert {r.doc_id for r in docs.collect()} == stay(before)
        if name == "substring_dedup":
            texts = {r.doc_id: r for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in texts.values())
            assert set(texts) == {r.doc_id for r in before.collect()}
            wanted = {i: (n - gone, sha) for i, n, gone, sha in brute([(r.doc_id, r.text) for r in before.collect()], corpus_pipeline.WINDOW)}
            assert {i: (len(w := WORD.findall(r.text)), hashlib.sha256(" ".join(w).encode()).hexdigest()) for i, r in texts.items()} == wanted
    assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2] and sizes[4] == sizes[3]
    full = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in full) <= 4096


def test_rows_without_text_and_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, "en", "s", 0), (2, "", None, None, 0), (None, "a b", "en", "s", 3)]):
        df = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
        df.collect()
