"""Queries of tokenizers, the sequence loader and long sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolith.functions import tokens
from mnemolith.operators import synthesis
from mnemolith.plans import tables as t
from mnemolith.plans.queries import query

WORDS = "regexp_extract_all({}, '\\S+')"
IDS = "list_transform({}, lambda w: ('0x' || substr(md5(w), 1, 7))::INT)"


@query(f"""WITH s AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents) SELECT doc_id::VARCHAR AS sequence_id, md5(array_to_string({IDS.format('w[1:256]')}, ' ')) AS token_md5, least(256, len(w)) AS n,
  '{{"lang":"' || lang || '","tokenization_source":"text"}}' AS metadata FROM s JOIN documents USING (doc_id)""")
def loaded_sequences(spark, sf_dir):
    """All documents as sequences of at most 256 words."""
    d = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sequence_id"), "text", "lang")
    got = tokens.load_sequences(d, tokens.tokenizer("blank"), 256)
    return got.select("sequence_id", F.md5(F.array_join("token_ids", " ")).alias("token_md5"), F.size("token_ids").alias("n"), "metadata")


@query(f"""WITH m AS (SELECT conv_id, turn, text, {WORDS.format('text')} AS w FROM conversations), p AS (SELECT *, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM m)
  SELECT conv_id, turn, len(w) AS n, md5(array_to_string({IDS.format('w')}, ' ')) AS ids_md5, length(regexp_extract(text, '\\S(.|\\s)*\\S|\\S')) AS reach, length(text) - length(ltrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS first_start FROM m WHERE len(w) > 0""")
def token_pieces(spark, sf_dir):
    """Ids and offsets of every message's words: where the first begins, and how far the last reaches from there."""
    m = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.tokenizer("blank")(F.col("text")).alias("p")).where(F.size("p") > 0)
    return m.select("conv_id", "turn", F.size("p").alias("n"), F.md5(F.array_join(tokens.ids(F.col("p")), " ")).alias("ids_md5"), (F.element_at("p", -1)["end"] - F.col("p")[0]["start"]).alias("reach"), F.col("p")[0]["start"].alias("first_start"))


# --- distractors ----------------------------------------------------------------------------------------------------------------

CYCLE = """ranked AS (SELECT *, row_number() OVER (ORDER BY sha256('{seed}:' || text_id) || ':' || text_id) - 1 AS place, count(*) OVER () AS n FROM pool)"""
BEGIN = "('0x' || substr(sha256('{seed}:start:' || {key}), 1, 12))::BIGINT % n"


@query(f"""WITH pool AS (SELECT doc_id AS text_id, lower(text) AS text FROM documents), {CYCLE.format(seed=0)}, i AS (SELECT item_id, lower(string_split(text, ' ')[1]) AS answer FROM benchmark),
  e AS (SELECT item_id, text_id, (place - {BEGIN.format(seed=0, key='item_id')} + n) % n AS k FROM i JOIN ranked ON text_id::VARCHAR <> item_id::VARCHAR AND NOT contains(text, answer))
  SELECT item_id AS target_id, text_id, row_number() OVER (PARTITION BY item_id ORDER BY k) AS rank FROM e QUALIFY rank <= 5""")
def distractor_candidates(spark, sf_dir):
    """Five documents for each benchmark item that don't hold its first word, read on from the item's own place in one order of all."""
    items = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target_id"), F.split("text", " ")[0].alias("answer"), F.lit(5).alias("need"))
    texts = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text", F.lit(1).alias("size"))
    return synthesis.read_on(items, texts, 0).select("target_id", "text_id", "rank")


def _examples(spark, sf_dir):
    """A conversation's middle message is the evidence, its first word the answer, its last message the question."""
    c = t.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("m"))
    middle = F.get("m", F.floor((F.size("m") - 1) / 2).cast("int"))
    return c.select(F.col("conv_id").cast("string").alias("example_id"), F.element_at("m", -1).alias("question"), F.coalesce(F.get(F.filter(F.split(middle, r"\s+"), lambda w: w != ""), F.lit(0)), F.lit("")).alias("answer"), middle.alias("evidence"), F.array_join("m", "\n").alias("conversation"))


def _long_sql(placement: str, length: int, seed: int = 13, bins: int = 4, block: int = 16, local: int = 64) -> str:
    fixed = placement == "fixed_start"
    wrap = synthesis.BETWEEN if fixed else synthesis.MEMORY
    lit = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    words = lambda x: WORDS.format(x)
    head = lit(synthesis.TASK) + (f" || {lit(synthesis.EARLIER)} || evidence" if fixed else "")
    lead = len((synthesis.TASK + synthesis.EARLIER).split()) if fixed else len(synthesis.MEMORY[0].split())

    def fill(name: str, need: str, s: int, rows: str) -> str:
        return f"""{name}0 AS MATERIALIZED (SELECT t.example_id, t.{need} AS need, p.w, (p.place - ('0x' || substr(sha256('{s}:start:' || t.example_id), 1, 12))::BIGINT % p.n + p.n) % p.n AS k
            FROM {rows} t JOIN (SELECT *, row_number() OVER (ORDER BY sha256('{s}:' || example_id) || ':' || example_id) - 1 AS place, count(*) OVER () AS n FROM pool) p ON p.example_id <> t.example_id AND NOT contains(lower(p.conversation), lower(t.answer)) WHERE t.{need} > 0),
          {name}1 AS (SELECT example_id, need, sum(len(w)) AS total FROM {name}0 GROUP BY ALL), {name}2 AS (SELECT example_id, unnest(range(((need + total - 1) // total)::BIGINT)) AS round FROM {name}1),
          {name} AS (SELECT example_id, flatten(list(w ORDER BY round, k))[1 : any_value(need)] AS x FROM {name}0 JOIN {name}2 USING (example_id) GROUP BY example_id)"""

    sql = f"""WITH c AS (SELECT conv_id::VARCHAR AS example_id, list(text ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
      e AS (SELECT example_id, m[len(m)] AS question, m[(len(m) - 1) // 2 + 1] AS evidence, array_to_string(m, chr(10)) AS conversation FROM c),
      x AS MATERIALIZED (SELECT *, coalesce({words('evidence')}[1], '') AS answer, {words(f"{head}")} AS h, {words("'Question: ' || question")} AS q, {words('evidence')} AS ev, {words(f"{lit(wrap[0])} || evidence || {lit(wrap[1])}")} AS ch FROM e),
      pool AS MATERIALIZED (SELECT example_id, conversation, {words(f"{lit(wrap[0])} || conversation || {lit(wrap[1])}")} AS w FROM x),
      f0 AS (SELECT *, {length} - 2 AS prompt_end, {length} - 2 - len(h) - len(q) AS memory FROM x WHERE answer <> ''),
      f1 AS MATERIALIZED (SELECT * FROM f0 WHERE memory > {'0' if fixed else 'len(ch)'} AND EXISTS (SELECT 1 FROM pool p WHERE p.example_id <> f0.example_id AND NOT contains(lower(p.conversation), lower(f0.answer)))"""
    if not fixed:
        sql += f" AND ((prompt_end - 1 - {local}) // {block} * {block} - len(ch) - (len(h) + {block - 1}) // {block} * {block}) // {block} + 1 >= {bins} AND (prompt_end - 1 - {local}) // {block} * {block} - len(ch) >= (len(h) + {block - 1}) // {block} * {block}"
    sql += f"), f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('{seed}:' || example_id) || ':' || example_id) - 1 AS place FROM f1)"
    if fixed:
        return sql + ", " + fill("d", "memory", seed, "f") + f""" SELECT example_id, place AS sequence_index, md5(array_to_string({IDS.format('h || x || q || [answer]')} || [1], ' ')) AS token_md5, {length} AS n, prompt_end AS answer_start, {lead} AS evidence_start, {lead} + len(ev) AS evidence_end,
          len(h) + memory AS question_start, prompt_end AS question_end, NULL::BIGINT AS chunk_start, NULL::BIGINT AS bin, memory AS distractor_tokens, prompt_end - {lead} - len(ev) AS distance FROM f JOIN d USING (example_id)"""
    first = f"(len(h) + {block - 1}) // {block} * {block}"
    sql += f""", g0 AS (SELECT *, place % {bins} AS bin, {first} AS first, ((prompt_end - 1 - {local}) // {block} * {block} - len(ch) - {first}) // {block} + 1 AS places FROM f),
      g1 AS (SELECT *, places * bin // {bins} AS low, places * (bin + 1) // {bins} AS high FROM g0),
      g2 AS (SELECT *, first + (low + ('0x' || substr(sha256('{seed}:' || example_id), 1, 12))::BIGINT % (high - low)) * {block} AS chunk_start FROM g1),
      g AS MATERIALIZED (SELECT *, chunk_start - len(h) AS before, memory - (chunk_start - len(h)) - len(ch) AS after FROM g2 WHERE memory - (chunk_start - len(h)) - len(ch) >= 0)"""
    sql += ", " + fill("a", "before", seed + 1, "g") + ", " + fill("b", "after", seed + 2, "g")
    return sql + f""" SELECT example_id, place AS sequence_index, md5(array_to_string({IDS.format('h || coalesce(a.x, []) || ch || coalesce(b.x, []) || q || [answer]')} || [1], ' ')) AS token_md5, {length} AS n, prompt_end AS answer_start, chunk_start + {lead} AS evidence_start, chunk_start + {lead} + len(ev) AS evidence_end,
      len(h) + memory AS question_start, prompt_end AS question_end, chunk_start, bin, memory - len(ch) AS distractor_tokens, prompt_end - chunk_start - {lead} - len(ev) AS distance FROM g LEFT JOIN a USING (example_id) LEFT JOIN b USING (example_id)"""


def _long(spark, sf_dir, placement, length):
    got = synthesis.long_sequences(_examples(spark, sf_dir), tokens.tokenizer("blank"), length, placement=placement, block=16, local=64)
    return got.select("example_id", "sequence_index", F.md5(F.array_join("token_ids", " ")).alias("token_md5"), F.size("token_ids").alias("n"), "answer_start", "evidence_start", "evidence_end", "question_start", "question_end", "chunk_start", "bin", "distractor_tokens", "distance")


@query(_long_sql("fixed_start", 1024))
def long_sequences(spark, sf_dir):
    """Of every conversation that fits a sequence of exactly 1,024 words, its evidence before the others."""
    return _long(spark, sf_dir, "fixed_start", 1024)


@query(_long_sql("stratified", 1536))
def long_sequences_stratified(spark, sf_dir):
    """Of exactly 1,536 words, the evidence in the next of four ranges of places among the others."""
    return _long(spark, sf_dir, "stratified", 1536)
