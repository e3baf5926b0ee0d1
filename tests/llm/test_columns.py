"""Extra columns whatever their names, and texts larger than an Arrow batch, in every operator and stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from mnemolith.llm import exact_dedup, merkle, mixing_lm, packing, piece_codec, quality, repeats, sharding, simhash, token_counts
from mnemolith.session import BATCH_BYTES

NAMES = ["a.b", "__sha", "__h", "__row", "__maybe", "__id", "__keep", "quality", "row", "key", "id", "sha", "h", "maybe", "starts", "new", "doc", "tag", "fp", "node", "root", "score", "keep", "own", "rank", "task", "to", "token", "n", "`tick"]
LONG = "some words of a long text " * (BATCH_BYTES // 20)
TEXTS = ["one text that stands twice here", "one  text that\nstands twice here", None, "", "a text of its own", LONG, LONG + "end"]


@pytest.fixture(scope="module")
def odd_columns(spark):
    rows = [(i, t, len(t or ""), *[f"{n}-{i}" for n in NAMES]) for i, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3)


def untouched(got, docs, ids):
    assert got.columns == docs.columns
    rows = {r[0]: r for r in got.collect()}
    assert set(rows) == set(ids)
    assert all(tuple(r[3:]) == tuple(f"{n}-{i}" for n in NAMES) for i, r in rows.items())


def test_stages_carry_columns(spark, odd_columns):
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_columns, labels)
    untouched(quality.drop_bad(odd_columns, model, 0.0), odd_columns, range(7))
    untouched(exact_dedup.drop_copies(odd_columns), odd_columns, [0, 2, 4, 5, 6])
    # the long texts' shingles are alike
    untouched(simhash.drop_near(odd_columns), odd_columns, [0, 2, 4, 5])
    untouched(repeats.without_repeats(odd_columns, window=corpus_pipeline.WINDOW), odd_columns, range(7))


def test_operators_take_columns(spark, odd_columns, tmp_path):
    d, n = odd_columns, len(TEXTS)
    words, model = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert packing.pack(d, words).select("doc_id").distinct().count() == n
    assert piece_codec.encode_documents(d, model).where("round_trip").count() == n
    assert mixing_lm.lm_scores(d, slots=14).where("score < 0").count() == n
    assert token_counts.token_counts(d, model, str(tmp_path / "cache")).count() == n
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.scores(d, quality.fit(d, labels)).count() == n
    assert sharding.shuffle_into_shards(d).count() == n
    assert simhash.near_components(d).count() == n
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(d).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}
    assert merkle.with_edits(d).count() == n
    report = {r.doc_id: r for r in repeats.repeat_report(d).collect()}
    assert len(report) == n and report[6].n_removed == report[5].n_words
