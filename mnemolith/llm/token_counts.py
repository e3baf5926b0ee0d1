"""Token counts through a digest cache.

The cache is a Parquet table (text_digest, tokenizer_digest, n_bytes,
n_tokens). A run joins the digests of its texts to it, encodes one text for
each digest it lacks, and appends those. A tokenizer's digest is that of its
file, so another version never meets stale counts.

The normal form of the content is the text itself, null being empty: anything
more could change a count. Two Bloom filters, of bounded size, tell which rows
are surely neither repeated nor in the cache: those are encoded where they are,
and only the others' texts shuffle. They are thinned in their own task before,
so a hot text sends one row from each.

Defined results: repeated rows are counted once and reported each; empty text
has 0 tokens; an empty table gives no rows and appends nothing; other columns
are ignored. A task that is run again appends nothing twice (Spark commits its
files once); two runs that append the same digest leave equal rows, of which
one is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from mnemolith.llm.common import Memo, quoted, text_or_empty
from mnemolith.llm.exact_dedup import bloom_filter, filter_test
from mnemolith.session import bounded_batches, cut

SCHEMA = "text_digest binary, tokenizer_digest string, n_bytes long, n_tokens long"
#: A run of spaces with what follows it; U+2581 is the model's own mark for a space.
PART = re.compile("[ ▁]+[^ ▁]*")


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=2)  # a worker keeps what it knows from task to task
def piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of whole texts as the library gives them.

    If no piece of the model has a space after another character, a merge never
    crosses into the next run of spaces, and a text's count is the sum over its
    parts; each part is encoded by the library once and remembered. Otherwise,
    or if the model changes texts before it encodes, whole texts are encoded.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    whole = any("▁" in p.lstrip("▁") for p in pieces) or model.normalize(" x  y ") != "▁▁x▁▁y▁"
    known = Memo()

    def count(texts: list[str]) -> list[int]:
        if whole:
            return [len(x) for x in model.encode(texts, num_threads=1)]
        out = []
        for text in texts:
            known.room()
            parts = PART.findall(" " + text)
            # the library puts one space before what it encodes
            if text and parts[-1] in (" ", "▁") and len(parts) > 1:
                parts.pop()
                last = 1
            else:
                last = 0
            new = [p for p in dict.fromkeys(parts) if p not in known]
            if new:
                known.learn(zip(new, map(len, model.encode([p[1:] for p in new], num_threads=1))))
            out.append(sum(map(known.__getitem__, parts)) + last)
        return out

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit. Appends what the cache lacked."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    bounded_batches(spark)
    text = text_or_empty(text_col)
    texts = docs.select(text.alias("text"), F.unhex(F.sha2(text, 256)).alias("text_digest"))
    keyed = cut(docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("text_digest")))

    def stored() -> DataFrame:
        try:
            cache = spark.read.schema(SCHEMA).parquet(cache_path)
        except AnalysisException:  # no cache yet
            cache = spark.createDataFrame([], SCHEMA)
        return cache.where(F.col("tokenizer_digest") == version)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            new = []
            for i, d in enumerate(b.column(0).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    new.append(i)
            yield b.take(pa.array(new, pa.int64()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(tokenizer_path)
        for b in (b for batch in once(batches) for b in [batch] if b.num_rows):
            texts = b.column(1).to_pylist()
            yield pa.record_batch([b.column(0), pa.array([version] * len(texts)), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(count(texts), pa.int64())], names=["text_digest", "tokenizer_digest", "n_bytes", "n_tokens"])

    h, cached = F.xxhash64("text_digest"), stored().select("text_digest")
    repeated = filter_test(spark, *bloom_filter(keyed.select(h), max(1, keyed.count()), 2))(h)
    n = cached.count()
    found = filter_test(spark, *bloom_filter(cached.select(h), n, 1))(h) if n else F.lit(False)
    marked = texts.withColumn("maybe", repeated | found).select("text_digest", "text", "maybe")
    single = marked.where("not maybe").select("text_digest", "text").mapInArrow(encode, SCHEMA)
    others = marked.where("maybe").select("text_digest", "text").mapInArrow(once, "text_digest binary, text string")
    misses = others.join(cached, "text_digest", "left_anti") if n else others.repartition("text_digest")
    single.unionByName(misses.select("text_digest", "text").mapInArrow(encode, SCHEMA)).write.mode("append").parquet(cache_path)
    # written once more, so that the join shuffles both its sides and Spark can split a hot text's rows
    counts = cut(stored().groupBy("text_digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens")))
    return keyed.join(counts, "text_digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
