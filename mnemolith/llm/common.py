"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable
from sys import getsizeof

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13.
BLANK = r"[\x20\x09-\x0D]+"


#: Bytes that a worker remembers of what it has worked out, at most.
REMEMBERED = 192 << 20


class Memo(dict):
    """What a worker has worked out. It starts anew once its keys and values take ``most`` bytes, so long ones count for what they are."""

    def __init__(self, most: int = REMEMBERED):
        super().__init__()
        self.most, self.used = most, 0

    def room(self) -> None:
        """To be called where nothing remembered is in use."""
        if self.used > self.most:
            self.clear()
            self.used = 0

    def learn(self, items: Iterable[tuple]) -> None:
        for k, v in items:
            self[k] = v
            self.used += getsizeof(k) + getsizeof(v) + 100

    def forget(self, k) -> None:
        v = self.pop(k)
        self.used -= getsizeof(k) + getsizeof(v) + 100


#: Shuffle partitions that one task works off at most: a sort's memory is held until its task ends.
TOGETHER = 8


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """How many tasks so many rows need, ``each`` for a task, so that small tables don't make a file in each of many tasks."""
    return max(1, -(-rows // each), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // TOGETHER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression, whatever dots or quotes it holds."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(quoted(col)), F.lit(""))


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """One column ``row`` that holds all columns of ``docs``, beside those given, so that no name of either can clash."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``packed`` put into ``row``."""
    return df.select([F.col(f"row.{quoted(c)}").alias(c) for c in columns])


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(quoted(col)).cast("string"), F.lit("")).cast("binary")) % n
