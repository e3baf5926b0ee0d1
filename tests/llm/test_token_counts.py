import public_tokenizers
import sentencepiece

from mnemolith.llm.token_counts import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_and_cache(spark, docs, odd, empty, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    cache = str(tmp_path / "cache")
    assert token_counts(empty, PATH, cache).count() == 0
    for df in (odd, docs, odd):
        want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in df.collect()), key=str)
        assert sorted((tuple(r) for r in token_counts(df, PATH, cache).collect()), key=str) == want
    stored = spark.read.parquet(cache)
    texts = {r.text or "" for r in docs.union(docs).collect()} | {r.text or "" for r in odd.collect()}
    assert stored.count() == stored.select("text_digest").distinct().count() == len(texts)
