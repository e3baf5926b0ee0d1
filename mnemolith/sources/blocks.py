"""A store of keyed blocks in versions, with an index of its files.

Every batch is written as a version of its own, in files that are sorted and
bounded by key, and becomes visible by one append to the index, which has a row
for each file: generation, version, file, lowest and highest key, rows. So a
lookup of some keys opens only the files that can hold them. ``compact`` writes
the last version of every key as one version of the next generation, and
``vacuum`` removes what no generation but the last needs.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith.session import cut, remove
from mnemolith.sources.tables import exists

INDEX = "generation int, version int, file string, low string, high string, rows long"


class BlockStore:
    """``key`` is a column of strings, distinct in each batch; all batches have the same columns."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def index(self) -> DataFrame:
        """The files of the last generation."""
        if not exists(self.spark, f"{self.path}/index"):
            return self.spark.createDataFrame([], INDEX)
        every = self.spark.read.schema(INDEX).parquet(f"{self.path}/index")
        last = every.agg(F.max("generation")).first()[0]
        return every.where(F.col("generation") == last)

    def _write(self, df: DataFrame, generation: int, version: int, files: int, kept: DataFrame | None) -> None:
        at = f"{self.path}/data/{generation}-{version}"
        # overwritten, since a version that isn't in the index was left by a run that failed
        df.repartitionByRange(files, self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(at)
        name = F.col("_metadata.file_path")
        rows = self.spark.read.parquet(at).groupBy(name.alias("file")).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("rows"))
        rows = rows.select(F.lit(generation).alias("generation"), F.lit(version).alias("version"), "file", "low", "high", "rows")
        rows = rows if kept is None else rows.unionByName(kept)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/index")

    def _last(self) -> tuple[int, int]:
        r = self.index().agg(F.max("generation").alias("g"), F.max("version").alias("v")).first()
        return (0, -1) if r.g is None else (r.g, r.v)

    def upsert(self, df: DataFrame, files: int = 8) -> int:
        """Adds a batch as the next version, in so many files."""
        generation, version = self._last()
        self._write(df, generation, version + 1, files, None)
        return version + 1

    def _read(self, files: DataFrame | list) -> DataFrame:
        rows = files if isinstance(files, list) else files.select("file", "version").collect()  # a row for each file
        df = self.spark.read.parquet(*[r.file for r in rows])
        version = F.regexp_extract(F.col("_metadata.file_path"), r"/data/\d+-(\d+)/[^/]*$", 1).cast("int")
        return df.select(*df.columns, version.alias("__version"))

    def _newest(self, rows: DataFrame, versions: int) -> DataFrame:
        if versions > 1:
            w = Window.partitionBy(self.key).orderBy(F.desc("__version"))
            rows = rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
        return rows.drop("__version")

    def latest(self) -> DataFrame:
        """The last version of every key; no shuffle where there is one version only."""
        files = self.index().collect()
        return self._newest(self._read(files), len({r.version for r in files}))

    def lookup(self, keys: DataFrame | list[str]) -> DataFrame:
        """The last version of the keys (a list, or a table with the key's column); only files whose range holds one of them are read."""
        files = sorted(self.index().collect(), key=lambda r: (r.version, r.low))
        wanted = (self.spark.createDataFrame([(k,) for k in keys], f"`{self.key}` string") if isinstance(keys, list) else keys.select(self.key)).distinct()
        wanted = cut(wanted)
        by_version: dict[int, list] = {}
        for n, r in enumerate(files):
            by_version.setdefault(r.version, []).append((r.low, r.high, n))
        lows = {v: [x[0].encode() for x in rows] for v, rows in by_version.items()}

        @F.pandas_udf("array<int>")
        def holders(k: pd.Series) -> pd.Series:
            def of(key: str) -> list[int]:
                out = []
                for v, rows in by_version.items():  # a version's files don't overlap
                    at = bisect_right(lows[v], key.encode()) - 1
                    if at >= 0 and key.encode() <= rows[at][1].encode():
                        out.append(rows[at][2])
                return out

            return k.map(of)

        hit = {r.n for r in wanted.where(F.col(self.key).isNotNull()).select(F.explode(holders(self.key)).alias("n")).distinct().collect()}  # files at most
        held = [files[n] for n in sorted(hit)]
        if not held:
            return self._read(files[:1]).drop("__version").where("false")
        return self._newest(self._read(held).join(wanted, self.key, "left_semi"), len({r.version for r in held}))

    def compact(self, files: int = 8) -> None:
        """One version of every key, in a new generation; readers see either."""
        generation, _ = self._last()
        self._write(self.latest(), generation + 1, 0, files, None)

    def vacuum(self) -> int:
        """Removes the data of all generations but the last; how many versions went."""
        every = self.spark.read.schema(INDEX).parquet(f"{self.path}/index")
        last, _ = self._last()
        old = [(r.generation, r.version) for r in every.where(F.col("generation") < last).select("generation", "version").distinct().collect()]
        for g, v in old:
            remove(self.spark, f"{self.path}/data/{g}-{v}")
        return len(old)
