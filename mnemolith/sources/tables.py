"""Writers with manifests, keyed upserts and resumable appends, and their readers. All are Spark writes; the committer makes them atomic."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = 1


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table is there."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in UTF-8, nulls written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_manifest(spark: SparkSession, path: str, manifest: dict, mode: str = "errorifexists") -> None:
    """One JSON line beside the data."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode(mode).text(f"{path}.manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}.manifest").first().value)


def create(df: DataFrame, path: str, manifest: dict, kind: str = "parquet") -> dict:
    """A new table and then its manifest, with version, row count and columns; an error if either is there. Without its manifest a table is not complete."""
    spark = df.sparkSession
    if kind == "json":
        write_jsonl(df, path)
        n = spark.read.text(path).count()
    else:
        df.write.mode("errorifexists").parquet(path)
        n = spark.read.parquet(path).count()
    whole = {"version": VERSION, "rows": n, "columns": df.columns, **manifest}
    write_manifest(spark, path, whole)
    return whole


def load(spark: SparkSession, path: str, dims: dict[str, int] | None = None) -> DataFrame:
    """The table of ``create``, once version, columns, count and the lengths ``dims`` of array columns agree."""
    manifest, df = read_manifest(spark, path), spark.read.parquet(path)
    wrong = [F.count_if(F.size(c) != n).alias(c) for c, n in (dims or {}).items()]
    got = df.agg(F.count("*").alias("__rows"), *wrong).first()
    faults = [f"version {manifest['version']}"] * (manifest["version"] != VERSION) + [f"{got['__rows']} rows, not {manifest['rows']}"] * (got["__rows"] != manifest["rows"])
    faults += [f"columns {df.columns}"] * (sorted(df.columns) != sorted(manifest["columns"])) + [f"{got[c]} rows of {c} haven't {n} numbers" for c, n in (dims or {}).items() if got[c]]
    if faults:
        raise ValueError("; ".join(faults))
    return df


def file_id(key: Column) -> Column:
    """A name safe for files: the first 20 hex digits of the key's SHA-256."""
    return F.substring(F.sha2(key, 256), 1, 20)


def block_faults(blocks: DataFrame) -> DataFrame:
    """(read_id, block_id, fault) of blocks that a read uses together (read_id, sequence_id, start_position, end_position, fingerprint, layers): one sequence, one fingerprint, one number of layers, no overlap."""
    order = Window.partitionBy("read_id", "sequence_id").orderBy("start_position", "end_position")
    every = Window.partitionBy("read_id")
    rules = {
        "sequences": F.min("sequence_id").over(every) != F.max("sequence_id").over(every),
        "fingerprint": F.min("fingerprint").over(every) != F.max("fingerprint").over(every),
        "layers": F.min("layers").over(every) != F.max("layers").over(every),
        "overlap": F.coalesce(F.lag("end_position").over(order) > F.col("start_position"), F.lit(False)),
    }
    tested = blocks.withColumns(rules)
    faults = F.array(*[F.when(F.col(n), F.lit(n)) for n in rules])
    return tested.select("read_id", "block_id", F.explode(F.array_compact(faults)).alias("fault"))


def append_missing(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key isn't in the table yet, so that a run that was cut off goes on where it ended; returns the whole table."""
    spark = df.sparkSession
    new = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if exists(spark, path) else df
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def markdown(df: DataFrame, title: str, *order: Column) -> DataFrame:
    """One row: a report (a bounded table) as Markdown."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]), F.lit(" |"))
    numbered = df.select(line.alias("line"), F.row_number().over(Window.orderBy(*order)).alias("at"))
    head = "\n".join((f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), ""))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return numbered.agg(F.concat(F.lit(head), body).alias("report"))
