"""Round trips through the sources and sinks: each query writes into a new folder of the shared ones and reads that back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.functions import text
from mnemolith.operators import planning
from mnemolith.plans import tables as t
from mnemolith.plans.queries import query, rounded
from mnemolith.session import cut, shared_dir
from mnemolith.sources import arrow, blocks, files
from mnemolith.sources import tables as store


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    c, path = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), _folder(spark, "jsonl")
    store.write_jsonl(c, path)
    return files.read_jsonl(spark, path, c._jdf.schema().toDDL())


@query("SELECT n_nationkey, n_name, 2 * row_number() OVER (ORDER BY n_nationkey) - 1 AS line_no FROM nation")
def jsonl_numbered(spark, sf_dir):
    """A blank line after each row: blank lines count and are no rows."""
    n, path = t.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _folder(spark, "lines")
    n.coalesce(1).orderBy("n_nationkey").select(F.concat(F.to_json(F.struct("*")), F.lit("\n"))).coalesce(1).write.text(path)
    return files.read_jsonl(spark, path, n._jdf.schema().toDDL(), ordered=True).drop("file")


@query("SELECT n_nationkey, n_name FROM nation")
def json_document(spark, sf_dir):
    """One document with a list for each split."""
    n, path = t.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _folder(spark, "document") + ".json"
    n.agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("train"), F.array().cast("array<string>").alias("test")), {"pretty": "true"})).coalesce(1).write.text(path)
    return files.read_local(spark, path, split="train").select(F.col("n_nationkey").cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), "n_name")


@query("SELECT count(*) AS texts, sum(n)::BIGINT AS characters FROM (SELECT sum(length(n_name) + 1) AS n FROM nation GROUP BY n_regionkey)")
def whole_text_files(spark, sf_dir):
    """A file is one text."""
    n, path = t.table(spark, sf_dir, "nation"), _folder(spark, "texts")
    n.select("n_name", "n_regionkey").repartition(1).write.partitionBy("n_regionkey").text(path)
    each = spark.read.text(path + "/*", wholetext=True)
    one = files.read_local(spark, _whole(n, path), text_field="value")
    return each.unionByName(one.where("false")).agg(F.count("*").alias("texts"), F.sum(F.length("value")).alias("characters"))


def _whole(n: DataFrame, path: str) -> str:
    n.select("n_name").coalesce(1).write.text(f"{path}_all.txt")
    return f"{path}_all.txt"


@query("SELECT doc_id, lang, length(text) AS n_chars FROM documents")
def arrow_streams(spark, sf_dir):
    """Two of three columns are read back."""
    d, path = t.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), _folder(spark, "arrow")
    arrow.write_streams(d, path)
    spark.dataSource.register(arrow.ArrowStreams)
    return spark.read.format("arrow_streams").option("columns", "doc_id,lang,text").load(path).select("doc_id", "lang", F.length("text").alias("n_chars"))


# --- evidence trees -------------------------------------------------------------------------------------------------------------

ITEMS = """WITH m AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
  i AS (SELECT conv_id, 'c' || (conv_id % 3) AS category, (1 + conv_id % 2)::VARCHAR AS evidence_count, trim(regexp_replace(max(text) FILTER (turn = last), '\\s+', ' ', 'g')) AS question, trim(regexp_replace(max(role || ' ' || turn) FILTER (turn = last), '\\s+', ' ', 'g')) AS answer FROM m GROUP BY conv_id),
  s AS (SELECT *, category || '/' || evidence_count || '/p_user_' || conv_id || '.json' AS source_file FROM i WHERE question <> '')"""


def write_tree(files_: DataFrame, root: str) -> None:
    """Files (path, value) under a folder, one by one."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = arrow.file_system(root)
        for b in batches:
            for path, value in zip(*(c.to_pylist() for c in b.columns)):
                fs.create_dir(f"{at}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{at}/{path}") as f:
                    f.write(value.encode())
        yield pa.record_batch([pa.array([0], pa.int64())], names=["done"])

    files_.mapInArrow(write, "done long").collect()


def _tree(spark, sf_dir: str) -> str:
    """A conversation is a file: its last message asks, the one before is evidence."""
    m = t.table(spark, sf_dir, "conversations")
    said = F.struct(F.lit("").alias("speaker"), "role", "text")
    c = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("m")))).alias("ms"))
    last, n = F.col("ms")[F.size("ms") - 1], F.size("ms")
    talk = F.transform("ms", lambda x: x["m"])
    item = F.struct(
        last["m"]["text"].alias("question"), F.concat_ws("  ", last["m"]["role"], last["turn"].cast("string")).alias("answer"), F.slice(talk, F.greatest(F.lit(1), n - 1), 1).alias("message_evidences"),
        F.array(F.struct(F.lit(False).alias("containsEvidence"), F.slice(talk, 1, 1).alias("messages")), F.struct((F.col("conv_id") % 2 == 0).alias("containsEvidence"), talk.alias("messages"))).alias("conversations"),
    )
    path = F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string"), F.lit("/"), (1 + F.col("conv_id") % 2).cast("string"), F.lit("/p_user_"), F.col("conv_id").cast("string"), F.lit(".json"))
    root = _folder(spark, "tree")
    write_tree(c.select(path.alias("path"), F.to_json(F.struct(F.array(item).alias("evidence_items"))).alias("value")), root)
    return root


@query(ITEMS + """, e AS (SELECT conv_id, trim(string_agg(role || ': ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10)) FILTER (turn = greatest(0, last - 1))) AS evidence, string_agg(trim(role || ': ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))), chr(10) ORDER BY turn) AS whole,
    string_agg(trim(role || ': ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))), chr(10) ORDER BY turn) FILTER (turn = 0) AS first FROM m GROUP BY conv_id)
  SELECT 'convomem-' || substr(sha1(source_file || ':0:' || question || ':' || answer), 1, 16) AS example_id, source_file, category, question, answer, md5(evidence) AS evidence_md5, md5(CASE WHEN conv_id % 2 = 0 THEN whole ELSE first END) AS conversation_md5 FROM s JOIN e USING (conv_id)""")
def evidence_examples(spark, sf_dir):
    e = files.evidence_examples(spark, _tree(spark, sf_dir))
    return e.select("example_id", "source_file", "category", "question", "answer", F.md5("evidence_context").alias("evidence_md5"), F.md5("conversation_context").alias("conversation_md5"))


@query(ITEMS + """ SELECT 'convomem_p_user_' || conv_id || '_0_' || substr(sha1(answer), 1, 10) AS target_fact_id, lower(question) AS question_key, category, evidence_count, 'p_user_' || conv_id AS entity, 'user ' || conv_id AS profile,
  'For the user ' || conv_id || ' user, ' || lower(substr(question, 1, 1)) || substr(question, 2) AS specific FROM s""")
def evidence_records(spark, sf_dir):
    r = files.evidence_records(spark, _tree(spark, sf_dir))
    return r.select("target_fact_id", "question_key", "category", "evidence_count", "entity", "profile", text.specific_question(F.col("profile"), F.col("question")).alias("specific"))


# --- corpora --------------------------------------------------------------------------------------------------------------------

META = """CASE doc_id % 6 WHEN 0 THEN '{"pile_set_name": "ArXiv"}' WHEN 1 THEN '{"subset": "arxiv"}' WHEN 2 THEN 'taken from arXiv, 2020' WHEN 3 THEN '{"pile_set_name": "", "source": "ARXIV"}' WHEN 4 THEN '{"pile_set_name": "Books"}' END"""


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text <> '' AND doc_id % 6 < 4")
def corpus_subset(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("meta", F.expr(META))
    return files.corpus_texts(d, "pile_arxiv", order="doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 20")
def corpus_first(spark, sf_dir):
    """The first twenty texts of a corpus: the number is the feature."""
    d = t.table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("meta", F.lit(None).cast("string"))
    return files.corpus_texts(d, "pg19", order="doc_id", max_documents=20).select("doc_id", F.length("text").alias("n_chars"))


# --- tables ---------------------------------------------------------------------------------------------------------------------


@query("SELECT vec_id AS id, label::BIGINT AS label, n AS manifest_rows FROM embeddings, (SELECT count(*) AS n FROM embeddings)")
def dataset_round_trip(spark, sf_dir):
    """Created once with its manifest, and loaded once that agrees."""
    path = _folder(spark, "dataset")
    manifest = store.create(t.vectors(spark, sf_dir), path, {"metadata": {"name": "embeddings"}})
    return store.load(spark, path, {"vector": 64}).select("id", "label", F.lit(manifest["rows"]).cast("long").alias("manifest_rows"))


def _blocks(spark, sf_dir):
    return planning.mechanical_blocks(t.sequences(spark, sf_dir), 256).select("block_id", "sequence_id", "start_position", "end_position")


BLOCKS = "WITH s AS (SELECT doc_id, doc_id::VARCHAR AS sequence_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n FROM documents), b AS (SELECT doc_id, sequence_id, unnest(range(n // 256)) AS i FROM s), k AS (SELECT *, sequence_id || ':' || lpad(i::VARCHAR, 7, '0') AS block_id FROM b)"


@query(BLOCKS + " SELECT block_id, substr(sha256(block_id), 1, 20) AS file_id, i * 256 + 256 AS end_position, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS payload FROM k")
def block_upsert(spark, sf_dir):
    """Every block is written, then those of every third sequence again; the last one counts."""
    b, path = _blocks(spark, sf_dir), _folder(spark, "blocks")
    s = blocks.BlockStore(spark, path, "block_id")
    s.upsert(b.withColumn("payload", F.lit("first")))
    s.upsert(b.where("sequence_id % 3 = 0").withColumn("payload", F.lit("second")))
    return s.latest().select("block_id", store.file_id(F.col("block_id")).alias("file_id"), "end_position", "payload")


@query(BLOCKS + " SELECT block_id, i * 256 + 256 AS end_position, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS payload, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS versions FROM k WHERE i = 0")
def block_lookup(spark, sf_dir):
    """The first block of every sequence, before and after the store is compacted: both must agree."""
    b, path = cut(_blocks(spark, sf_dir)), _folder(spark, "lookup")
    s = blocks.BlockStore(spark, path, "block_id")
    s.upsert(b.withColumn("payload", F.lit("first")))
    s.upsert(b.where("sequence_id % 3 = 0").withColumn("payload", F.lit("second")))
    keys = b.where("start_position = 0").select("block_id")
    before = cut(s.lookup(keys).select("block_id", "sequence_id", "end_position", "payload"))
    s.compact()
    s.vacuum()
    after = s.lookup(keys).select("block_id", "end_position", "payload")
    return before.join(after, ["block_id", "end_position", "payload"]).select("block_id", "end_position", "payload", F.when(F.col("sequence_id").cast("long") % 3 == 0, 2).otherwise(1).alias("versions"))


@query(BLOCKS + """, f AS (SELECT sequence_id, block_id, i * 256 - CASE WHEN i % 3 = 2 THEN 1 ELSE 0 END AS s, i * 256 + 256 AS e, CASE WHEN i = 1 AND doc_id % 2 = 0 THEN 'b' ELSE 'a' END AS p, CASE WHEN i = 2 AND doc_id % 5 = 0 THEN 3 ELSE 4 END AS layers FROM k),
  o AS (SELECT *, lag(e) OVER (PARTITION BY sequence_id ORDER BY s, e) AS before, min(p) OVER w <> max(p) OVER w AS mixed, min(layers) OVER w <> max(layers) OVER w AS uneven FROM f WINDOW w AS (PARTITION BY sequence_id))
  SELECT sequence_id AS read_id, block_id, 'overlap' AS fault FROM o WHERE before > s UNION ALL SELECT sequence_id, block_id, 'fingerprint' FROM o WHERE mixed UNION ALL SELECT sequence_id, block_id, 'layers' FROM o WHERE uneven""")
def block_faults(spark, sf_dir):
    """A read of every sequence's blocks, some of which begin too early, are of another fingerprint, or have other layers."""
    i = F.floor(F.col("start_position") / 256)
    doc = F.col("sequence_id").cast("long")
    b = _blocks(spark, sf_dir).select(F.col("sequence_id").alias("read_id"), "block_id", "sequence_id", (F.col("start_position") - F.when(i % 3 == 2, 1).otherwise(0)).alias("start_position"), "end_position", F.when((i == 1) & (doc % 2 == 0), "b").otherwise("a").alias("fingerprint"), F.when((i == 2) & (doc % 5 == 0), 3).otherwise(4).alias("layers"))
    return store.block_faults(b)


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'first run' ELSE 'second run' END AS run FROM conversations")
def resumed_append(spark, sf_dir):
    """A run that was cut off wrote half of the rows; the next one appends what is missing."""
    c, path = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("key")), _folder(spark, "append")
    store.append_missing(c.where("turn % 2 = 0").withColumn("run", F.lit("first run")), path, "key")
    return store.append_missing(c.withColumn("run", F.lit("second run")), path, "key").drop("key")


@query("SELECT lang, count(*) AS documents, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY lang")
def metrics_dump(spark, sf_dir):
    m, path = rounded(t.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.avg("n_chars").alias("mean_chars"))), _folder(spark, "metrics")
    store.write_jsonl(m, path)
    return files.read_jsonl(spark, path, m._jdf.schema().toDDL())


@query("""SELECT '# Regions' || chr(10) || chr(10) || '| region | nations |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || region || ' | ' || n || ' |', chr(10) ORDER BY region) AS report
  FROM (SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name)""")
def markdown_report(spark, sf_dir):
    r = t.table(spark, sf_dir, "region").join(t.table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("nations"))
    return store.markdown(r, "Regions", F.col("region"))
