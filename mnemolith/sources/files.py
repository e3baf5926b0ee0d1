"""Readers of files into DataFrames; every one is a scan that Spark splits over tasks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith.functions.text import message_text, one_line, profile_of, short_sha1
from mnemolith.session import cut

# The corpora known by name, with their split, text column, subset and window sizes.
PRESETS = {
    "wikitext103": {"text_field": "text", "subset": None},
    "wikitext103_raw": {"text_field": "text", "subset": None},
    "pg19": {"text_field": "text", "subset": None},
    "pile_arxiv": {"text_field": "text", "subset": "ArXiv"},
}

#: An evidence file's items, as far as they are used.
MESSAGE = "struct<speaker:string,role:string,text:string,content:string>"
EVIDENCE = f"evidence_items array<struct<question:string,answer:string,message_evidences:array<{MESSAGE}>,conversations:array<struct<containsEvidence:boolean,messages:array<{MESSAGE}>>>>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, value) of text files.

    Lines are counted within each split of a file; the splits' counts give where each begins, so no task sees a whole file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = cut(lines.withColumn("at", F.monotonically_increasing_id()))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return lines.withColumn("within", within).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("within")).alias("line_no"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str, ordered: bool = False) -> DataFrame:
    """One row for each JSON line; blank lines are skipped and a bad one is an error.

    ``ordered`` adds file and line_no, and the error names them.
    """
    if not ordered:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    failed = F.raise_error(F.concat(F.lit("bad JSON in "), "file", F.lit(" line "), F.col("line_no").cast("string"))).cast("bigint")
    return parsed.withColumn("line_no", F.when(bad, failed).otherwise(F.col("line_no"))).select("file", "line_no", "row.*").drop("_corrupt")


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file's one JSON document (or list of them) as rows."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_local(spark: SparkSession, path: str, text_field: str = "text", split: str = "train") -> DataFrame:
    """Rows of a file by its kind: .jsonl; .json (a list, or lists by split); .txt or .text (the whole file is one row); else Parquet, with a folder for each split if it has them."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".jsonl":
        return spark.read.option("mode", "FAILFAST").json(path)
    if kind == ".json":
        rows = read_json_document(spark, path)
        return rows.select(F.inline(split)) if split in rows.columns and rows.schema[split].dataType.typeName() == "array" else rows
    if kind in (".txt", ".text"):
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", text_field)
    if kind not in ("", ".parquet"):
        raise ValueError(f"no reader for {path}")
    rows = spark.read.parquet(path)
    return rows.where(F.col("split") == split).drop("split") if "split" in rows.columns else rows


def matches_subset(meta: Column, subset: str) -> Column:
    """Whether a row's metadata (JSON, or plain text) names the subset: by pile_set_name, subset or source, whatever the case; plain text may hold it anywhere."""
    parsed = F.try_parse_json(meta)
    field = lambda name: F.nullif(F.try_variant_get(parsed, f"$.{name}", "string"), F.lit(""))
    named = F.lower(F.coalesce(field("pile_set_name"), field("subset"), field("source"), F.lit(""))) == subset.lower()
    return F.when(meta.isNull() | (meta == ""), F.lit(not subset)).when(parsed.isNull(), F.contains(F.lower(meta), F.lit(subset.lower()))).otherwise(named)


def corpus_texts(rows: DataFrame, preset: str, text_field: str | None = None, meta: str = "meta", order: str | None = None, max_documents: int | None = None) -> DataFrame:
    """(text) of a known corpus: its subset only, texts that aren't empty, the first ``max_documents`` by ``order`` if asked for; a missing text is an error."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; choose from {sorted(PRESETS)}")
    spec = PRESETS[preset]
    field = text_field or spec["text_field"]
    chosen = rows.where(matches_subset(F.col(meta), spec["subset"])) if spec["subset"] else rows
    text = F.when(F.col(field).isNull(), F.raise_error(F.lit(f"a row has no {field}"))).otherwise(F.col(field))
    some = chosen.withColumn("text", text).where("text <> ''")
    return (some.orderBy(order).limit(max_documents) if max_documents is not None else some).select(*[c for c in (order,) if c], "text")


def _joined(messages: Column, collapse: bool) -> Column:
    return F.array_join(F.transform(messages, lambda m: message_text(m["speaker"], m["role"], m["text"], m["content"], collapse)), "\n")


def chosen_conversation(conversations: Column) -> Column:
    """The first conversation that holds evidence, else the first; null without any."""
    return F.coalesce(F.get(F.filter(conversations, lambda c: F.coalesce(c["containsEvidence"], F.lit(False))), F.lit(0)), F.get(conversations, F.lit(0)))


def evidence_items(spark: SparkSession, root: str) -> DataFrame:
    """Items of the files root/category/count/name.json, with their file, category, count and place."""
    files = spark.read.schema(EVIDENCE).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/*/*/*.json")
    path = F.slice(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -3, 3)
    named = files.select(F.array_join(path, "/").alias("source_file"), path[0].alias("category"), path[1].alias("evidence_count"), F.posexplode("evidence_items").alias("source_item_index", "item"))
    return named.select("*", one_line(F.coalesce("item.question", F.lit(""))).alias("question"), one_line(F.coalesce("item.answer", F.lit(""))).alias("answer")).where("question <> '' AND answer <> ''")


def evidence_examples(spark: SparkSession, root: str) -> DataFrame:
    """(example_id, source_file, source_item_index, category, question, answer, evidence_context, conversation_context); items without question, answer or evidence are left out."""
    items = evidence_items(spark, root).withColumn("evidence_context", F.coalesce(_joined(F.col("item.message_evidences"), True), F.lit("")))
    chosen = chosen_conversation(F.col("item.conversations"))
    talk = F.coalesce(F.nullif(_joined(chosen["messages"], True), F.lit("")), F.col("evidence_context"))
    digest = F.concat_ws(":", "source_file", F.col("source_item_index").cast("string"), "question", "answer")
    return items.where("evidence_context <> ''").select(
        F.concat(F.lit("convomem-"), short_sha1(digest, 16)).alias("example_id"), "source_file", "source_item_index", "category", "question", "answer", "evidence_context", talk.alias("conversation_context")
    )


def evidence_records(spark: SparkSession, root: str) -> DataFrame:
    """The same items in the prompt builders' shape: profile, fact id, keys; messages keep their white space."""
    items = evidence_items(spark, root).withColumn("evidence_context", F.coalesce(_joined(F.col("item.message_evidences"), False), F.lit("")))
    stem = F.regexp_extract("source_file", r"([^/]+)\.json$", 1)
    fact = F.concat_ws("_", F.lit("convomem"), stem, F.col("source_item_index").cast("string"), short_sha1(F.col("answer")))
    return items.where(F.trim("evidence_context") != "").select(
        "question", F.lower("question").alias("question_key"), "answer", F.lower("answer").alias("answer_key"), "evidence_context", F.col("item.conversations").alias("conversations"), F.col("item.message_evidences").alias("evidence"),
        fact.alias("target_fact_id"), "category", "evidence_count", "source_file", "source_item_index", stem.alias("entity"), F.replace(profile_of(F.col("source_file")), F.lit("_"), F.lit(" ")).alias("profile"),
    )
