"""The corpus pipeline: stages in order, each written as Parquet and read again.

1. quality: documents that the compression classifier scores below ``LEAST`` go.
2. exact_dedup: of equal texts (white space runs as one space) one row stays.
3. near_dedup: of texts whose five-word shingles are 0.8 alike or more, one stays.
4. substring_dedup: words of spans of ``WINDOW`` words or more met in an earlier document are cut.
5. pack: what is left is packed into sequences of 4096 tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemolith.llm import exact_dedup, packing, quality, repeats, simhash
from mnemolith.llm.common import documents
from mnemolith.session import remove, shared_dir

#: Words of the shortest repeated span that goes.
WINDOW = 45
#: The least score of a document that stays.
LEAST = 0.5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_bad(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), LEAST)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs, window=WINDOW)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", good), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("pack", pack)]

#: Stages 1, 3 and 5 can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline_{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{root}/{k}_{name}")
        docs = spark.read.parquet(path)
        if before:  # what the next stage was made of
            remove(spark, before)
        before = path
    return docs
