"""Queries of sequential evaluation, assembled samples, conflicts and running means of slots, repeated questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemolith.functions.vector import dot, unit
from mnemolith.operators import prepare, stream_eval, upkeep
from mnemolith.operators.attention import block_mass, block_target
from mnemolith.plans import tables as t
from mnemolith.plans.queries import ATT, U, query, rounded

E = """e AS (SELECT event_id, user_id % 8 AS stream, event_type, value, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS seq FROM events),
  w AS (SELECT *, seq // 64 AS win FROM e), l AS (SELECT stream, event_type, win, arg_max(value, seq) AS last FROM w GROUP BY ALL),
  r AS (SELECT w.*, l.last AS recalled FROM w ASOF LEFT JOIN l ON w.stream = l.stream AND w.event_type = l.event_type AND l.win < w.win),
  m AS (SELECT stream, win, abs(value) AS base, CASE WHEN recalled IS NULL THEN abs(value) ELSE abs(value - recalled) END AS memory FROM r),
  s AS (SELECT 'base' AS method, stream, win, count(*) AS tokens, sum(base) AS nll FROM m GROUP BY ALL UNION ALL SELECT 'memory', stream, win, count(*), sum(memory) FROM m GROUP BY ALL)"""


def _losses(spark, sf_dir):
    """Events of eight streams in windows of 64; a memory recalls the last value of an event's type."""
    e = t.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("stream"), "event_type", "value", "ts")
    e = e.withColumn("seq", F.row_number().over(t.by_order(F.col("stream"), "ts", "event_id")) - 1).withColumn("win", F.floor(F.col("seq") / 64))
    r = stream_eval.recalled(e, "event_type", "value")
    return stream_eval.window_losses(r, {"base": F.abs("value"), "memory": F.abs(F.col("value") - F.coalesce("recalled", F.lit(0.0)))})


@query(f"""WITH {E} SELECT method, stream, win, tokens, round(nll, 4) AS nll, round(nll / tokens, 6) AS log_perplexity,
  round(sum(nll) OVER w / sum(tokens) OVER w, 6) AS log_so_far FROM s WINDOW w AS (PARTITION BY method, stream ORDER BY win ROWS UNBOUNDED PRECEDING)""")
def stream_evaluation(spark, sf_dir):
    p = stream_eval.perplexities(_losses(spark, sf_dir))
    return rounded(p.select("method", "stream", "win", "tokens", F.round("nll", 4).alias("nll"), F.log("perplexity").alias("log_perplexity"), F.log("so_far").alias("log_so_far")))


@query(f"""WITH {E}, b AS (SELECT s.*, x.nll / x.tokens AS bl FROM s JOIN s x USING (stream, win) WHERE x.method = 'base')
  SELECT method, sum(tokens)::BIGINT AS tokens, round(sum(nll) / sum(tokens), 6) AS log_perplexity, round((sum(bl * tokens) - sum(nll)) / sum(tokens), 6) AS gain, round(avg((nll / tokens < bl)::INT), 6) AS windows_won FROM b GROUP BY method""")
def stream_comparison(spark, sf_dir):
    c = stream_eval.comparison(_losses(spark, sf_dir), "base")
    return rounded(c.select("method", "tokens", F.log("perplexity").alias("log_perplexity"), "gain", "windows_won"))


@query(ATT + """, k AS (SELECT vec_id // 50 AS sample_id, (vec_id % 50) // 8 AS i, avg(embedding[1]::DOUBLE) AS x FROM embeddings WHERE vec_id % 50 < 40 GROUP BY ALL), asked AS (SELECT sample_id, v[1] AS q FROM e WHERE pos = 40)
  SELECT k.sample_id, round(any_value(q), 6) AS first_query, count(*)::INT AS n, array_to_string(list(k.sample_id || ':' || i ORDER BY i), ',') AS block_ids, round(sum(x * conditional), 6) AS weighed, round(list_last(list(conditional ORDER BY i)), 6) AS last_mass
  FROM k JOIN c ON c.sample_id = k.sample_id AND c.block_index = k.i JOIN asked ON asked.sample_id = k.sample_id GROUP BY k.sample_id""")
def assembled_samples(spark, sf_dir):
    """Plans, the query's state, the blocks' mean states and their shares of attention as one row for each sample."""
    v = t.vectors(spark, sf_dir).select(F.floor(F.col("id") / t.SAMPLE).alias("sample_id"), (F.col("id") % t.SAMPLE).cast("int").alias("pos"), "vector")
    query_ = v.where(F.col("pos") == t.KEYS).select("sample_id", F.transform("vector", lambda x: x.cast("double")).alias("query"))
    past = v.where(F.col("pos") < t.KEYS).withColumn("cand_index", F.floor(F.col("pos") / t.BLOCK).cast("int"))
    mean = past.select("sample_id", "cand_index", F.posexplode("vector").alias("i", "x")).groupBy("sample_id", "cand_index", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    blocks = mean.groupBy("sample_id", "cand_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("summary")).withColumn("block_id", F.concat_ws(":", "sample_id", "cand_index"))
    plans = past.select("sample_id", "cand_index").distinct().withColumn("block_id", F.concat_ws(":", "sample_id", "cand_index"))
    target = block_target(block_mass(t.attention(spark, sf_dir), t.BLOCK)).select("sample_id", F.col("block_index").cast("int").alias("cand_index"), F.col("conditional").alias("mass"))
    # samples whose query is there; the last one may be short
    ready = query_.select("sample_id")
    got = stream_eval.assembled(plans.join(ready, "sample_id", "left_semi"), query_, blocks.select("block_id", "summary"), target.join(ready, "sample_id", "left_semi"))
    weighed = dot(F.transform("summaries", lambda s: s[0]), F.col("masses"))
    return rounded(got.select("sample_id", F.col("query")[0].alias("first_query"), F.size("block_ids").alias("n"), F.array_join("block_ids", ",").alias("block_ids"), weighed.alias("weighed"), F.element_at("masses", -1).alias("last_mass")))


@query(f"""WITH {U}, y AS (SELECT id, label, list_transform(x[1:8], lambda a: a / sqrt(list_dot_product(x[1:8], x[1:8]))) AS y, exp(-0.001 * id) AS w FROM u), d AS (SELECT label, unnest(y) AS a, generate_subscripts(y, 1) AS i, w FROM y), s AS (SELECT label, i, sum(a * w) AS s FROM d GROUP BY ALL),
  n AS (SELECT label, sqrt(sum(s * s)) AS n FROM s GROUP BY label), m AS (SELECT label, sum(w) AS m FROM y GROUP BY label) SELECT label AS slot, round(1 - n / m, 6) AS conflict FROM n JOIN m USING (label)""")
def slot_conflict(spark, sf_dir):
    """How much the values of a slot's records disagree, by sums of unit vectors."""
    r = t.records(spark, sf_dir).select("stream", "slot", "vector", F.slice(unit(F.col("value")), 1, 8).alias("value"), F.exp(-0.001 * F.col("write_time")).alias("w"))
    return rounded(upkeep.conflict(r, "slot"))


@query("""WITH v AS (SELECT vec_id AS id, label AS slot, embedding[1]::DOUBLE AS x, 1 + vec_id % 3 AS n FROM embeddings)
  SELECT id, slot, sum(n) OVER w::BIGINT AS records, round(sum(x * n) OVER w / sum(n) OVER w, 6) AS mean FROM v WINDOW w AS (PARTITION BY slot ORDER BY id ROWS UNBOUNDED PRECEDING)""")
def running_means(spark, sf_dir):
    """The mean value of a slot after each write, weighted by counts."""
    v = t.vectors(spark, sf_dir).select("id", F.col("label").alias("slot"), F.col("vector")[0].cast("double").alias("x"), (1 + F.col("id") % 3).alias("n"))
    w = t.by_order(F.col("slot"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(v.select("id", "slot", F.sum("n").over(w).alias("records"), (F.sum(F.col("x") * F.col("n")).over(w) / F.sum("n").over(w)).alias("mean")))


@query("""WITH q AS (SELECT doc_id, lang AS category, 'q' || (doc_id % 40) AS question_key, md5(text)[1:2] AS answer_key, source AS source_file, doc_id AS source_item_index, doc_id::VARCHAR AS fact FROM documents),
  o AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY category, question_key, answer_key ORDER BY source_file, source_item_index) = 1),
  n AS (SELECT *, count(*) OVER (PARTITION BY category, question_key) AS answers, row_number() OVER (PARTITION BY category, question_key ORDER BY sha256('13:' || fact), fact) AS rank FROM o),
  k AS (SELECT * FROM n WHERE answers >= 2 AND rank <= 4), g AS (SELECT category, question_key, count(*) AS n, sha256('13:' || category || ':' || question_key) AS o FROM k GROUP BY ALL ORDER BY o, category, question_key LIMIT 60),
  u AS (SELECT *, row_number() OVER x AS group_rank, 60 - (sum(n) OVER x - n) AS room FROM g WINDOW x AS (ORDER BY o, category, question_key))
  SELECT k.category, k.question_key, fact AS target_fact_id, rank, group_rank FROM k JOIN u USING (category, question_key) WHERE room >= 2 AND rank <= room""")
def repeated_questions(spark, sf_dir):
    """Questions that documents answer in different ways, four records of each and sixty in all: the numbers are the feature."""
    d = t.table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.concat(F.lit("q"), (F.col("doc_id") % 40).cast("string")).alias("question_key"), F.substring(F.md5("text"), 1, 2).alias("answer_key"), F.col("source").alias("source_file"), F.col("doc_id").alias("source_item_index"), F.col("doc_id").cast("string").alias("target_fact_id"))
    return prepare.repeated_questions(d, 60).select("category", "question_key", "target_fact_id", "rank", "group_rank")
