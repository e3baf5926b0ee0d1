"""Registered queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith.functions import hashing, text, vector
from mnemolith.operators import attention as att
from mnemolith.operators import lm_eval, planning, prepare, retrieval, similarity, temporal, trajectory
from mnemolith.plans import tables as t
from mnemolith.streaming import memory

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PLACES = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select([F.round(c, PLACES).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# --- similarity -----------------------------------------------------------------------------------------------------------------

V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label::BIGINT AS label FROM embeddings)"
U = V + ", u AS (SELECT id, label, list_transform(x, lambda a: a / sqrt(list_dot_product(x, x))) AS x FROM v)"
NEAR = f"""WITH {U}, s AS (SELECT q.id AS query_id, q.label AS query_label, r.id, r.label, round(list_dot_product(q.x, r.x), 12) AS score
  FROM u q JOIN u r ON q.id <> r.id WHERE q.id % 100 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM s QUALIFY rank <= 10)"""


def _near(spark: SparkSession, sf_dir: str, metric: str = "cosine", higher: bool = True) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    v = t.vectors(spark, sf_dir)
    return similarity.neighbours(v, v.where("id % 100 = 0"), 10, metric, higher)


@query(NEAR + " SELECT query_id, id, label, round(score, 6) AS score, rank FROM k")
def knn_neighbours(spark, sf_dir):
    return rounded(_near(spark, sf_dir).select("query_id", "id", "label", "score", "rank"))


KNN_REPORT = """, e AS (SELECT query_id, max(CASE WHEN label = query_label AND rank = 1 THEN 1.0 ELSE 0 END) AS t, max(CASE WHEN label = query_label THEN 1.0 ELSE 0 END) AS h,
  coalesce(1.0 / min(CASE WHEN label = query_label THEN rank END), 0) AS r FROM k GROUP BY ALL)
  SELECT count(*) AS queries, round(avg(t), 6) AS top1, round(avg(h), 6) AS recall, round(avg(r), 6) AS mrr FROM e"""


@query(NEAR + KNN_REPORT)
def knn_query_report(spark, sf_dir):
    return rounded(similarity.retrieval_report(_near(spark, sf_dir), 10))


@query(NEAR + " SELECT query_label, label, count(*) AS n FROM k WHERE rank = 1 GROUP BY ALL")
def knn_confusion(spark, sf_dir):
    return similarity.confusion(_near(spark, sf_dir))


ZNEAR = f"""WITH {V}, d AS (SELECT id, label, unnest(x) AS a, generate_subscripts(x, 1) AS dim FROM v), z AS (SELECT dim, avg(a) AS m, greatest(stddev_samp(a), 1e-6) AS s FROM d GROUP BY dim),
  u AS (SELECT id, label, list((a - m) / s ORDER BY dim) AS x FROM d JOIN z USING (dim) GROUP BY id, label),
  s AS (SELECT q.id AS query_id, q.label AS query_label, r.id, r.label, list_distance(q.x, r.x) AS score FROM u q JOIN u r ON q.id <> r.id WHERE q.id % 100 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s QUALIFY rank <= 10)"""


@query(ZNEAR + " SELECT query_id, id, label, round(score, 6) AS score, rank FROM k")
def zscore_neighbours(spark, sf_dir):
    v = similarity.zscored(t.vectors(spark, sf_dir))
    return rounded(similarity.neighbours(v, v.where("id % 100 = 0"), 10, "euclid", False).select("query_id", "id", "label", "score", "rank"))


@query(ZNEAR + KNN_REPORT)
def zscore_report(spark, sf_dir):
    v = similarity.zscored(t.vectors(spark, sf_dir))
    return rounded(similarity.retrieval_report(similarity.neighbours(v, v.where("id % 100 = 0"), 10, "euclid", False), 10))


PAIRS = """ SELECT count(*) FILTER (a.label = b.label) AS same_pairs, count(*) FILTER (a.label <> b.label) AS different_pairs,
  round(avg(list_dot_product(a.x, b.x)) FILTER (a.label = b.label), 6) AS same_mean, round(avg(list_dot_product(a.x, b.x)) FILTER (a.label <> b.label), 6) AS different_mean,
  round(avg(list_dot_product(a.x, b.x)) FILTER (a.label = b.label) - avg(list_dot_product(a.x, b.x)) FILTER (a.label <> b.label), 6) AS margin FROM u a JOIN u b ON a.id < b.id"""
C = V.replace("embedding::DOUBLE[]", "list_transform(embedding::DOUBLE[], lambda a: a - list_avg(embedding::DOUBLE[]))")


@query(f"WITH {U}" + PAIRS)
def pair_similarity_buckets(spark, sf_dir):
    return rounded(similarity.pair_means(t.vectors(spark, sf_dir)))


@query(f"WITH {C}, u AS (SELECT id, label, list_transform(x, lambda a: a / sqrt(list_dot_product(x, x))) AS x FROM v)" + PAIRS)
def centered_cosine_buckets(spark, sf_dir):
    return rounded(similarity.pair_means(t.vectors(spark, sf_dir), centre=True))


@query(f"""WITH {U}, s AS (SELECT q.id AS query_id, q.label AS query_label, r.id, r.label, round(list_dot_product(q.x, r.x), 12) AS score FROM u q JOIN u r ON q.id % 100 = 0 AND r.id % 2 = 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM s QUALIFY rank <= 5)""" + KNN_REPORT)
def query_to_fact_report(spark, sf_dir):
    """Odd ids are the facts; of the even ones, which ask, the hundredths are the query set."""
    v = t.vectors(spark, sf_dir)
    return rounded(similarity.retrieval_report(similarity.neighbours(v.where("id % 2 = 1"), v.where("id % 100 = 0"), 5), 5))


@query(f"""WITH {U}, s AS (SELECT id % 4 AS suite, id, label, x FROM u), p AS (SELECT a.suite, a.label = b.label AS same, list_dot_product(a.x, b.x) AS c FROM s a JOIN s b ON a.suite = b.suite AND a.id < b.id)
  SELECT suite, count(*) FILTER (same) AS same_pairs, count(*) FILTER (NOT same) AS different_pairs, round(avg(c) FILTER (same), 6) AS same_mean, round(avg(c) FILTER (NOT same), 6) AS different_mean,
  round(avg(c) FILTER (same) - avg(c) FILTER (NOT same), 6) AS margin FROM p GROUP BY suite""")
def suite_report(spark, sf_dir):
    return rounded(similarity.pair_means(t.vectors(spark, sf_dir).withColumn("suite", F.col("id") % 4), ["suite"]))


@query(f"""WITH {U}, p AS (SELECT a.id % 4 AS method, a.label = b.label AS same, list_dot_product(a.x, b.x) AS c FROM u a JOIN u b ON a.id % 4 = b.id % 4 AND a.id < b.id),
  m AS (SELECT method, round(avg(c) FILTER (same) - avg(c) FILTER (NOT same), 6) AS margin FROM p GROUP BY method)
  SELECT method, margin, CASE WHEN margin >= 0.8 THEN 'go' WHEN margin >= 0.6 THEN 'promising' WHEN margin >= 0.4 THEN 'weak' ELSE 'stop' END AS advice FROM m ORDER BY margin DESC, method LIMIT 1""")
def best_method(spark, sf_dir):
    r = rounded(similarity.pair_means(t.vectors(spark, sf_dir).withColumn("method", F.col("id") % 4), ["method"])).withColumn("all", F.lit(1))
    return similarity.best_by(r, "all", F.desc("margin"), F.asc("method")).select("method", "margin", similarity.recommendation(F.col("margin"), F.lit(0.0)).alias("advice"))


# --- splits, conversations, prompts ---------------------------------------------------------------------------------------------

BUCKET = "(('0x' || substr(sha256({k}), 1, 16))::UBIGINT % 10000)"


@query(f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations), b AS (SELECT conv_id, {BUCKET.format(k="'wildchat:13:' || conv_id::VARCHAR")} AS b FROM c)
  SELECT conv_id, CASE WHEN b < 9000 THEN 'train' WHEN b < 9500 THEN 'validation' ELSE 'test' END AS split FROM b""")
def hash_split_rows(spark, sf_dir):
    return t.table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("split", hashing.row_split(F.col("conv_id")))


@query(f"""WITH b AS (SELECT doc_id, {BUCKET.format(k="'13:' || source")} AS b FROM documents)
  SELECT CASE WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'validation' ELSE 'test' END AS split, count(*) AS documents FROM b GROUP BY ALL""")
def hash_split_groups(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select(F.concat(F.lit("corpus/"), "source", F.lit(".json")).alias("path"))
    return d.groupBy(hashing.source_split(F.col("path")).alias("split")).agg(F.count("*").alias("documents"))


@query("""WITH g AS (SELECT source, row_number() OVER (ORDER BY sha256('7:' || source)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
  SELECT source, n > 1 AND r <= least(n - 1, greatest(1, round_even(n * 0.2, 0)::BIGINT)) AS validation, count(*) AS documents FROM documents JOIN g USING (source) GROUP BY ALL""")
def grouped_validation_split(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select("source")
    return hashing.grouped_split(d, "source", 0.2, 7).groupBy("source", "validation").agg(F.count("*").alias("documents"))


@query("SELECT conv_id, turn, lower(trim(role)) AS role, trim(text, ' ') AS text FROM conversations WHERE lower(trim(role)) IN ('system', 'user', 'assistant') AND trim(text, ' ') <> ''")
def clean_messages(spark, sf_dir):
    return prepare.clean_messages(t.table(spark, sf_dir, "conversations"))


@query(f"""WITH c AS (SELECT conv_id, count(*) AS n_messages, string_agg(lower(trim(role)) || ': ' || trim(text, ' '), chr(10) ORDER BY turn) AS text FROM conversations
  WHERE lower(trim(role)) IN ('system', 'user', 'assistant') AND trim(text, ' ') <> '' GROUP BY conv_id)
  SELECT conv_id, n_messages, text FROM c WHERE n_messages // 2 >= 2 AND {BUCKET.format(k="'wildchat:13:' || conv_id::VARCHAR")} < 9000""")
def long_conversations(spark, sf_dir):
    return prepare.long_conversations(t.table(spark, sf_dir, "conversations"), "train", 2).select("conv_id", "n_messages", "text")


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS m FROM conversations GROUP BY conv_id), e AS (SELECT conv_id, m, len(m) AS n, len(m) // 2 AS mid FROM c),
  w AS (SELECT *, greatest(0, least(mid - 1, n - 3)) AS s FROM e) SELECT conv_id, array_to_string(m[s + 1 : s + 3], chr(10)) AS context FROM w""")
def conversation_context_window(spark, sf_dir):
    """Three messages around the middle one, which is taken for the evidence."""
    m = t.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("m"))
    # messages are told apart by their place, so that equal ones aren't evidence too
    tagged = F.transform("m", lambda x, i: F.concat(i.cast("string"), F.lit(":"), x))
    middle = F.floor(F.size("m") / 2).cast("int")
    evidence = F.array(F.concat(middle.cast("string"), F.lit(":"), F.get("m", middle)))
    window = prepare.evidence_window(tagged, evidence, 3)
    return m.select("conv_id", F.array_join(F.transform(window, lambda x: F.regexp_replace(x, r"^\d+:", "")), "\n").alias("context"))


def _prompts(spark, sf_dir):
    """A conversation's last message asks, the one before is its evidence."""
    c = t.table(spark, sf_dir, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    name = F.concat(F.lit("D1:"), F.col("turn").cast("string"))
    qa = c.where("turn = last AND last > 0").select(F.col("conv_id").alias("index"), F.col("conv_id").cast("string").alias("user_name"), F.lit("c").alias("conversation_id"), F.col("text").alias("question"), F.lit("a").alias("answer"), F.array(F.concat(F.lit("D1:"), (F.col("turn") - 1).cast("string"))).alias("evidence_turn_ids"))
    turns = c.where("turn < last").select(F.col("conv_id").cast("string").alias("user_name"), name.alias("turn_id"), "role", F.col("text").alias("content"))
    return prepare.evidence_prompts(qa, turns, 3, 2).select("entity", "condition_id", F.md5("prompt").alias("prompt_md5"))


@query("""WITH t AS (SELECT conv_id, turn, text, role, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), q AS (SELECT conv_id, text AS question FROM t WHERE turn = last AND last > 0),
  l AS (SELECT conv_id, turn, turn = last - 1 AS own, upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text AS line FROM t WHERE turn < last),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS late, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn DESC) AS other FROM l),
  u AS (SELECT conv_id, 'evidence_only' AS condition_id, string_agg(line, chr(10) ORDER BY turn) AS context FROM r WHERE own GROUP BY conv_id
    UNION ALL SELECT conv_id, 'recent_context', string_agg(line, chr(10) ORDER BY turn) FROM r WHERE late <= 3 GROUP BY conv_id
    UNION ALL SELECT conv_id, 'noisy_context', string_agg(line, chr(10) ORDER BY own, turn) FROM r WHERE own OR other <= 2 GROUP BY conv_id)
  SELECT conv_id::VARCHAR AS entity, condition_id, md5('Conversation evidence:' || chr(10) || context || chr(10) || chr(10) || 'Memory request: ' || trim(question, ' ') || chr(10) || 'Question: ' || trim(question, ' ')) AS prompt_md5 FROM u JOIN q USING (conv_id)""")
def evidence_prompts(spark, sf_dir):
    """All three prompts of each question."""
    return _prompts(spark, sf_dir)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS row FROM documents)
  SELECT doc_id AS source, 0 AS article_index, doc_id::VARCHAR AS title, md5(' = ' || doc_id::VARCHAR || ' = ' || string_agg(line, '' ORDER BY row)) AS text_md5 FROM l GROUP BY doc_id""")
def article_segments(spark, sf_dir):
    """Lines of each document under a heading of its id."""
    d = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.posexplode(F.concat(F.array(F.concat(F.lit(" = "), F.col("doc_id").cast("string"), F.lit(" = "))), F.split("text", "\n"))).alias("row", "line"))
    return prepare.articles(d).select("source", F.col("article_index").cast("int").alias("article_index"), "title", F.md5("text").alias("text_md5"))


@query("""WITH s AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents) SELECT doc_id, array_to_string(w[1:64], ' ') AS tokens FROM s WHERE len(w) >= 64 AND doc_id % 2 = 1 ORDER BY doc_id LIMIT 50""")
def exact_sequences(spark, sf_dir):
    """The first fifty of every second document with 64 tokens: the count and length are the feature."""
    d = t.table(spark, sf_dir, "documents")
    got = prepare.exact_sequences(d, F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 64, 50, "doc_id", 2, 13)
    return got.select("doc_id", F.array_join("token_ids", " ").alias("tokens"))


def _text(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)


PROMPT_FACTS = [(i, e, c, prepare.COLORS[(i + 3) % len(prepare.COLORS)]) for i, (e, c) in enumerate(zip(prepare.ENTITIES, prepare.COLORS))]
PROMPT_ROWS = [(f"noise_{k}", "recall_color", f"noise_@_{k}", "v", "{v}", f"{note}\nFact: {{e}}'s color is {{v}}.\n{{q}}".strip(), True, False) for k, note in enumerate(prepare.NOTES)]
PROMPT_ROWS += [("absent", "absent_color", "absent_@", "v", "unknown", "{absent}", False, False), *((c, task, f"{p}_@", w, a, x, True, c == "conflict_latest") for c, task, p, w, a, x in prepare.TEMPLATES)]


@query(f"""WITH f AS (SELECT * FROM (VALUES {_values(PROMPT_FACTS)}) t(i, e, v, o)), m AS (SELECT * FROM (VALUES ('natural'), ('canonical')) t(mode)),
  r AS (SELECT * FROM (VALUES {_values(PROMPT_ROWS)}) t(condition_id, task_id, name, which, answer, template, has_fact, conflict)),
  q AS (SELECT *, CASE mode WHEN 'canonical' THEN replace({_text(prepare.CANONICAL)}, '{{e}}', e) ELSE 'What is ' || e || {_text("'s color? Return only the color.")} END AS question FROM f, m, r)
  SELECT mode || '_' || replace(name, '@', i::VARCHAR) AS prompt_id, task_id, lower(e) || '_color_' || CASE which WHEN 'o' THEN o ELSE v END AS target_fact_id, condition_id, mode, e AS entity, 'color' AS attribute, CASE which WHEN 'o' THEN o ELSE v END AS value,
  replace(replace(replace(answer, '{{e}}', e), '{{v}}', v), '{{o}}', o) AS answer, has_fact, conflict, CASE WHEN template = '{{absent}}' THEN CASE mode WHEN 'canonical' THEN question ELSE 'No color is given for ' || e || '. ' || question END ELSE replace(replace(replace(replace(template, '{{q}}', question), '{{e}}', e), '{{v}}', v), '{{o}}', o) END AS prompt FROM q""")
def synthetic_prompts(spark, sf_dir):
    return prepare.synthetic_prompts(spark)


@query("""SELECT 'distance_sweep' AS condition, 0::BIGINT AS history_start_position, g::BIGINT AS requested_gap FROM (VALUES (0), (512), (2048)) t(g)
  UNION ALL SELECT 'joint_shift_control', s, 256 FROM (VALUES (0), (8192)) t(s)""")
def condition_plan(spark, sf_dir):
    return prepare.condition_plan(spark, (0, 512, 2048), (0, 8192), 256)


# --- planning -------------------------------------------------------------------------------------------------------------------

S = "s AS (SELECT doc_id::VARCHAR AS sequence_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_tokens FROM documents)"
PLANS = f"""WITH {S}, r AS (SELECT sequence_id, unnest(CASE WHEN n_tokens - 10 >= 95 THEN range(95, n_tokens - 9, 16) END) AS p FROM s)"""


@query(f"""WITH {S}, b AS (SELECT sequence_id, unnest(range(n_tokens // 32)) AS i FROM s)
  SELECT sequence_id, i::INT AS block_index, sequence_id || ':' || lpad(i::VARCHAR, 7, '0') AS block_id, i * 32 AS start_position, (i + 1) * 32 AS end_position FROM b""")
def mechanical_blocks(spark, sf_dir):
    return planning.mechanical_blocks(t.sequences(spark, sf_dir), 32)


def _plans(spark, sf_dir):
    return planning.retrieval_plans(t.sequences(spark, sf_dir), local=64, block=32, horizon=8, interval=16, least=1)


@query(PLANS + """ SELECT sequence_id || ':' || lpad(p::VARCHAR, 9, '0') AS sample_id, sequence_id, p AS retrieval_position, p + 1 AS first_future_position, 8 AS horizon, p - 63 AS local_start, p + 1 AS local_end,
  ((p - 63) // 32)::INT AS n_candidates FROM r""")
def retrieval_plans(spark, sf_dir):
    return _plans(spark, sf_dir)


@query(PLANS + """, c AS (SELECT sequence_id || ':' || lpad(p::VARCHAR, 9, '0') AS sample_id, sequence_id, (p - 63) // 32 AS n FROM r), f AS (SELECT *, greatest(0, n - 8) AS f FROM c), i AS (SELECT *, unnest(range(f, n)) AS i FROM f)
  SELECT sample_id, (i - f)::INT AS cand_index, sequence_id || ':' || lpad(i::VARCHAR, 7, '0') AS block_id, i * 32 AS start_position, (i + 1) * 32 AS end_position FROM i""")
def plan_candidates(spark, sf_dir):
    return planning.plan_candidates(_plans(spark, sf_dir), block=32, most=8)


@query(PLANS + " SELECT sequence_id, count(*) AS samples FROM r GROUP BY ALL")
def expected_samples(spark, sf_dir):
    return _plans(spark, sf_dir).groupBy("sequence_id").agg(F.count("*").alias("samples"))


@query(f"""WITH {S}, p AS (SELECT sequence_id, unnest(range(0, n_tokens, 7)) AS pos FROM s) SELECT sequence_id, pos // 32 AS block_index, count(*) AS points FROM p JOIN s USING (sequence_id) WHERE pos < n_tokens // 32 * 32 GROUP BY ALL""")
def interval_points(spark, sf_dir):
    s = t.sequences(spark, sf_dir)
    points = s.where("n_tokens > 0").select("sequence_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(7).cast("long"))).alias("pos"))
    found = planning.interval_join(points, planning.mechanical_blocks(s, 32), "sequence_id", "pos", "start_position", "end_position", 64)
    return found.groupBy("sequence_id", F.col("block_index").cast("long").alias("block_index")).agg(F.count("*").alias("points"))


# --- attention ------------------------------------------------------------------------------------------------------------------

ATT = """WITH e AS (SELECT vec_id // 50 AS sample_id, vec_id % 50 AS pos, embedding::DOUBLE[] AS v FROM embeddings),
  d AS (SELECT f.sample_id, lh // 2 AS layer, lh % 2 AS head, f.pos - 40 AS future_index, k.pos AS key_position, list_dot_product(f.v[lh * 16 + 1 : lh * 16 + 16], k.v[lh * 16 + 1 : lh * 16 + 16]) / 4 AS s
    FROM e f JOIN e k ON f.sample_id = k.sample_id AND f.pos >= 40 AND k.pos < 40, range(4) t(lh)),
  x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample_id, layer, head, future_index)) AS x FROM d), a AS (SELECT *, x / sum(x) OVER (PARTITION BY sample_id, layer, head, future_index) AS p FROM x),
  m AS (SELECT sample_id, future_index, key_position // 8 AS block_index, sum(p) / 4 AS mass FROM a GROUP BY ALL),
  b AS (SELECT sample_id, block_index, avg(mass) AS absolute FROM m GROUP BY ALL), c AS (SELECT *, sum(absolute) OVER (PARTITION BY sample_id) AS total, absolute / sum(absolute) OVER (PARTITION BY sample_id) AS conditional FROM b),
  q AS (SELECT k.sample_id, k.pos // 8 AS block_index, avg(list_dot_product(f.v, k.v)) AS score FROM e k JOIN e f ON f.sample_id = k.sample_id AND f.pos = 40 AND k.pos < 40 GROUP BY ALL),
  cand AS (SELECT sample_id, block_index::INT AS cand_index, (block_index * 8)::INT AS start_position, (block_index * 8 + 8)::INT AS end_position, score, conditional AS mass FROM q JOIN c USING (sample_id, block_index)),
  soft AS (SELECT *, exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS p FROM cand WINDOW w AS (PARTITION BY sample_id))"""


def _mass(spark, sf_dir):
    return att.block_mass(t.attention(spark, sf_dir), t.BLOCK)


@query(ATT + " SELECT sample_id, block_index::INT AS block_index, round(absolute, 6) AS absolute, round(total, 6) AS total, round(conditional, 6) AS conditional FROM c")
def block_attention_mass(spark, sf_dir):
    return rounded(att.block_target(_mass(spark, sf_dir)))


@query(ATT + " SELECT sample_id, future_index::INT AS future_index, block_index::INT AS block_index, round(mass, 6) AS mass FROM m")
def per_future_mass(spark, sf_dir):
    return rounded(_mass(spark, sf_dir))


@query(ATT + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_index) AS bs, row_number() OVER (PARTITION BY sample_id ORDER BY mass DESC, cand_index) AS bm FROM soft),
  each AS (SELECT sample_id, sum(-mass * ln(greatest(p, 1e-12))) AS ce, sum(mass * (ln(greatest(mass, 1e-12)) - ln(greatest(p, 1e-12)))) AS kl, sum(-mass * ln(greatest(mass, 1e-12))) AS te, sum(-p * ln(greatest(p, 1e-12))) AS pe,
    max(CASE WHEN bs = 1 AND bm = 1 THEN 1.0 ELSE 0 END) AS t, sum(CASE WHEN bs <= 2 AND bm <= 2 THEN 1.0 ELSE 0 END) / sum(CASE WHEN bm <= 2 THEN 1.0 ELSE 0 END) AS r, sum(mass) FILTER (bs <= 2) AS cov, sum(mass) FILTER (bm <= 2) AS oc FROM ranked GROUP BY sample_id)
  SELECT count(*) AS samples, round(avg(ce), 6) AS ce, round(avg(kl), 6) AS kl, round(avg(te), 6) AS target_entropy, round(avg(pe), 6) AS predicted_entropy, round(avg(t), 6) AS top1, round(avg(r), 6) AS recall, round(avg(cov), 6) AS coverage, round(avg(oc), 6) AS oracle_coverage FROM each""")
def router_metrics(spark, sf_dir):
    scores = t.candidates(spark, sf_dir).select("sample_id", F.col("cand_index").alias("block_index"), "score")
    return rounded(att.router_metrics(scores, att.block_target(_mass(spark, sf_dir)), 2))


@query(ATT + " SELECT sample_id, count(*) AS n, round(sum(-p * ln(greatest(p, 1e-12))), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(greatest(p, 1e-12))) / ln(count(*)) ELSE 0 END, 6) AS normalised_entropy FROM soft GROUP BY sample_id")
def retrieval_entropy(spark, sf_dir):
    return rounded(retrieval.decision_entropy(t.candidates(spark, sf_dir)))


@query(ATT + """, r AS (SELECT sample_id, layer, key_position // 8 AS block_index, head, future_index AS event, sum(p) AS mass, 8 AS length, 40 AS key_len FROM a GROUP BY ALL),
  h AS (SELECT sample_id, layer, block_index, head, avg(mass) AS mass, avg(length) AS length, avg(length / key_len) AS uniform FROM r GROUP BY ALL)
  SELECT sample_id, layer::INT AS layer, block_index::INT AS block_index, round(avg(length), 6) AS mean_tokens, round(avg(mass), 6) AS mean_mass, round(max(mass), 6) AS max_head_mass, round(avg(mass) / avg(uniform), 6) AS enrichment, sum(CASE WHEN mass / uniform >= 2 THEN 1 ELSE 0 END)::BIGINT AS heads_twice FROM h GROUP BY sample_id, layer, block_index""")
def attention_event_summary(spark, sf_dir):
    """Of every layer and block."""
    a = t.attention(spark, sf_dir).withColumns({"layer": F.col("layer").cast("int"), "block_index": F.floor(F.col("key_position") / t.BLOCK).cast("int")})
    events = a.groupBy("sample_id", "layer", "block_index", "head", F.col("future_index").alias("event")).agg(F.sum("p").alias("mass")).withColumns({"length": F.lit(t.BLOCK), "key_len": F.lit(t.KEYS)})
    return rounded(att.event_summary(events, ["sample_id", "layer", "block_index"]))


def _top(policy: str, order: str):
    sql = ATT + f""" SELECT sample_id, cand_index, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {order}) AS rank FROM cand) WHERE rank <= 2"""

    def f(spark, sf_dir):
        return retrieval.select_top(t.candidates(spark, sf_dir), policy, 2, 5).select("sample_id", "cand_index", "rank")

    f.__name__ = f"topn_{policy}"
    query(sql)(f)


for _policy, _order in (("learned", "score DESC, cand_index"), ("oracle", "mass DESC, cand_index"), ("recent", "end_position DESC, cand_index"), ("oldest", "start_position, cand_index"), ("random", "sha256('5:' || sample_id || ':' || cand_index)")):
    _top(_policy, _order)


@query(ATT + " SELECT sample_id, cand_index, rank, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_index) AS rank FROM soft) WHERE rank <= 3 AND p >= 0.2")
def topn_threshold(spark, sf_dir):
    return rounded(retrieval.select_threshold(t.candidates(spark, sf_dir), 3, 0.2).select("sample_id", "cand_index", "rank", "p"))


SWEEP = ATT + "".join(f", r_{p} AS (SELECT sample_id, '{p}' AS policy, mass, row_number() OVER (PARTITION BY sample_id ORDER BY {o}) AS rank FROM cand)" for p, o in (("learned", "score DESC, cand_index"), ("oracle", "mass DESC, cand_index"), ("recent", "end_position DESC, cand_index"), ("oldest", "start_position, cand_index"), ("random", "sha256('0:' || sample_id || ':' || cand_index)"))) + """,
  every AS (SELECT * FROM r_learned UNION ALL SELECT * FROM r_oracle UNION ALL SELECT * FROM r_recent UNION ALL SELECT * FROM r_oldest UNION ALL SELECT * FROM r_random),
  sw AS (SELECT sample_id, policy, budget, sum(mass) FILTER (rank <= budget) AS covered FROM every, (VALUES (1), (2), (4)) t(budget) GROUP BY ALL)"""


@query(SWEEP + " SELECT policy, budget, count(*) AS n, round(avg(covered), 6) AS mean FROM sw GROUP BY ALL")
def sweep_summary(spark, sf_dir):
    return rounded(retrieval.mean_summary(retrieval.sweep(t.candidates(spark, sf_dir), [1, 2, 4]), ["policy", "budget"], "covered"))


@query(SWEEP + """, pd AS (SELECT a.budget, b.policy AS baseline, round(a.covered - b.covered, 9) AS d FROM sw a JOIN sw b ON a.sample_id = b.sample_id AND a.budget = b.budget AND a.policy = 'learned' AND b.policy <> 'learned')
  SELECT budget, baseline, count(*) AS n, round(avg(d), 6) AS mean_difference, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0 END), 6) AS tie_rate FROM pd GROUP BY ALL""")
def paired_comparison(spark, sf_dir):
    s = retrieval.sweep(t.candidates(spark, sf_dir), [1, 2, 4]).withColumn("covered", F.round("covered", 9))
    wide = retrieval.paired(s)
    return rounded(wide)


POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(n)) for n in range(1, 10)]


def _resampled(table: str, by: str, key: str, value: str, iterations: int, seed: int) -> str:
    """SQL of ``retrieval.bootstrap``."""
    times = " + ".join(f"(u >= {p!r})::INT" for p in POISSON)
    return f""", dr AS (SELECT {by}, {value} AS v, i, ('0x' || substr(md5('{seed}:' || {key} || ':' || i), 1, 12))::BIGINT / 281474976710656.0 AS u FROM {table}, range({iterations}) r(i)),
  rs AS (SELECT {by}, i, sum(({times}) * v) / nullif(sum({times}), 0) AS m FROM dr GROUP BY ALL), ls AS (SELECT {by}, list(m ORDER BY m) FILTER (m IS NOT NULL) AS m FROM rs GROUP BY ALL)"""


@query(SWEEP + _resampled("sw", "policy, budget", "sample_id || ':' || policy || ':' || budget", "covered", 2000, 3) + " SELECT policy, budget, round(m[floor(0.025 * len(m))::INT + 1], 6) AS low, round(m[least(len(m) - 1, floor(0.975 * len(m))::INT) + 1], 6) AS high FROM ls")
def bootstrap_ci(spark, sf_dir):
    return rounded(retrieval.bootstrap(retrieval.sweep(t.candidates(spark, sf_dir), [1, 2, 4]), ["policy", "budget"], ["sample_id", "policy", "budget"], "covered", 2000, 3))


@query(SWEEP + """, pd AS (SELECT a.sample_id, a.budget, b.policy AS baseline, round(a.covered - b.covered, 9) AS d FROM sw a JOIN sw b ON a.sample_id = b.sample_id AND a.budget = b.budget AND a.policy = 'learned' AND b.policy <> 'learned')"""
       + _resampled("pd", "budget, baseline", "sample_id || ':' || budget || ':' || baseline", "d", 2000, 1) + " SELECT budget, baseline, round(m[floor(0.025 * len(m))::INT + 1], 6) AS low, round(m[least(len(m) - 1, floor(0.975 * len(m))::INT) + 1], 6) AS high FROM ls")
def paired_intervals(spark, sf_dir):
    """Of the mean differences of paired_comparison."""
    s = retrieval.sweep(t.candidates(spark, sf_dir), [1, 2, 4]).withColumn("covered", F.round("covered", 9))
    d = retrieval.differences(s).withColumn("d", F.round("d", 9))
    return rounded(retrieval.bootstrap(d, ["budget", "baseline"], ["sample_id", "budget", "baseline"], "d", 2000, 1))


CONFIGS = "c AS (SELECT event_type || ':' || (user_id % 20) AS config, round(avg(value), 6) AS quality, count(*) AS bytes, round(stddev_samp(value), 6) AS latency FROM events GROUP BY ALL)"


def _configs(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    return rounded(e.groupBy(F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("config")).agg(F.avg("value").alias("quality"), F.count("*").alias("bytes"), F.stddev_samp("value").alias("latency")))


@query(f"""WITH {CONFIGS} SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.quality >= a.quality AND b.bytes <= a.bytes AND b.latency <= a.latency AND (b.quality > a.quality OR b.bytes < a.bytes OR b.latency < a.latency))""")
def pareto_frontier(spark, sf_dir):
    return retrieval.pareto(_configs(spark, sf_dir), "config", "quality", "bytes", "latency")


@query(f"WITH {CONFIGS} SELECT * FROM c WHERE bytes <= (SELECT median(bytes) FROM c) ORDER BY quality DESC, bytes, latency, config LIMIT 1")
def best_under_budget(spark, sf_dir):
    c = _configs(spark, sf_dir)
    return retrieval.best_under_budget(c, c.agg(F.median("bytes")), "bytes", F.desc("quality"), F.asc("bytes"), F.asc("latency"), F.asc("config"))


# --- temporal memory ------------------------------------------------------------------------------------------------------------

REC = f"""WITH {U}, w AS (SELECT id AS record_id, label AS slot, id::DOUBLE AS write_time, x AS vector, lead(id) OVER (PARTITION BY label ORDER BY id) AS superseded_by FROM u)"""


@query(REC + " SELECT record_id, slot FROM w WHERE superseded_by IS NULL")
def asof_visible_current(spark, sf_dir):
    return temporal.visible(t.records(spark, sf_dir), "current").select("record_id", "slot")


@query(REC + ", m AS (SELECT floor(max(write_time) / 2) AS till FROM w) SELECT record_id, slot FROM w, m WHERE write_time <= till AND (superseded_by IS NULL OR superseded_by > till)")
def asof_visible_historical(spark, sf_dir):
    r = t.records(spark, sf_dir)
    r = r.crossJoin(F.broadcast(r.agg(F.floor(F.max("write_time") / 2).alias("at"))))
    return temporal.visible(r, "historical", F.col("at")).select("record_id", "slot")


@query(REC + """, n AS (SELECT max(write_time) AS now FROM w) SELECT record_id, round(exp(-0.001 * (now - write_time)) * power(1e-6 + 1, 0.5) * (CASE WHEN superseded_by IS NULL THEN 1 ELSE 0 END), 6) AS weight FROM w, n""")
def record_weights(spark, sf_dir):
    """Every record at the last write's time."""
    r = t.records(spark, sf_dir)
    r = r.crossJoin(F.broadcast(r.agg(F.max("write_time").alias("now"))))
    w = vector.record_weight(F.col("now"), F.col("write_time"), F.col("write_time"), F.lit(1.0), F.when(F.col("superseded_by").isNull(), 0.0).otherwise(1.0), F.lit(True), age_decay=0.001, gain_power=0.5)
    return rounded(r.select("record_id", w.alias("weight")))


@query(REC + """, d AS (SELECT slot, unnest(vector) AS a, generate_subscripts(vector, 1) AS dim FROM w), s AS (SELECT slot, dim, sum(a) AS s FROM d GROUP BY ALL), n AS (SELECT slot, sqrt(sum(s * s)) AS norm FROM s GROUP BY slot),
  c AS (SELECT slot, count(*) AS records, count(*)::DOUBLE AS mass, min(write_time) AS first_time, max(write_time) AS last_time FROM w GROUP BY slot), r AS (SELECT *, norm / (mass + 1) AS r FROM c JOIN n USING (slot))
  SELECT slot, records, mass, round(norm / mass, 6) AS resultant, round(least(100, r * (64 - r * r) / (1 - r * r)), 6) AS concentration, round(mass - norm, 6) AS scatter, first_time, last_time FROM r""")
def slot_statistics(spark, sf_dir):
    return rounded(temporal.slot_statistics(t.records(spark, sf_dir), 64).drop("stream"))


@query(REC + """, d AS (SELECT slot, unnest(vector) AS a, generate_subscripts(vector, 1) - 1 AS dim FROM w) SELECT slot, dim::INT AS dim, round(avg(a), 6) AS mean FROM d GROUP BY ALL""")
def slot_centroids(spark, sf_dir):
    return rounded(temporal.centroids(t.records(spark, sf_dir), ["slot"]))


@query(f"WITH {V}, r AS (SELECT sum(160 + 8 * 3 * len(x))::BIGINT AS record_bytes FROM v), s AS (SELECT sum(b)::BIGINT AS slot_bytes FROM (SELECT 192 + 8 * (64 + count(*)) AS b FROM v GROUP BY label)) SELECT record_bytes, slot_bytes, record_bytes + slot_bytes AS bytes FROM r, s")
def memory_bytes(spark, sf_dir):
    r = t.records(spark, sf_dir)
    return temporal.memory_bytes(r, r.groupBy("slot").agg(F.count("*").alias("records")).withColumn("dims", F.lit(64)))


@query(f"""WITH {V}, s AS (SELECT q.id AS query_id, r.id AS record_id, list_dot_product(q.x, r.x) / 8 + 0.5 / (1 + abs(q.id - r.id)) AS score FROM v q JOIN v r ON q.label = r.label AND r.id < q.id AND q.id % 100 = 0)
  SELECT query_id, record_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id DESC) AS rank FROM s QUALIFY rank <= 4""")
def native_rerank(spark, sf_dir):
    """Every hundredth record reads its own slot's earlier records; ties go to the newest."""
    r = t.records(spark, sf_dir)
    q = r.where("record_id % 100 = 0").select(F.col("record_id").alias("query_id"), "slot", F.col("key").alias("q"), F.col("write_time").alias("now"))
    pairs = q.join(r, "slot").where("record_id < query_id")
    s = vector.native_score(F.col("q"), F.col("key"), F.col("now"), F.col("write_time"), F.lit(0.0), F.lit(1), dims=64, time_bias=0.5)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("record_id"))
    return rounded(pairs.select("query_id", "record_id", s.alias("score")).withColumn("rank", F.row_number().over(w)).where("rank <= 4"))


@query(f"""WITH {V}, p AS (SELECT q.id AS query_id, list_dot_product(q.x, r.x) / 8 + ln(1 + r.id % 3) AS s, r.x AS val FROM v q JOIN v r ON q.label = r.label AND q.id % 100 = 0),
  e AS (SELECT query_id, val, exp(s - max(s) OVER (PARTITION BY query_id)) AS e FROM p), a AS (SELECT query_id, val, e / sum(e) OVER (PARTITION BY query_id) AS a FROM e),
  d AS (SELECT query_id, a, unnest(val) AS x, generate_subscripts(val, 1) - 1 AS dim FROM a) SELECT query_id, dim::INT AS dim, round(sum(a * x), 6) AS value FROM d GROUP BY ALL""")
def attention_readout(spark, sf_dir):
    v = t.vectors(spark, sf_dir)
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label", F.col("vector").alias("q"))
    m = v.select("label", "id", F.col("vector").alias("key"), F.col("vector").alias("value"), (F.col("id") % 3 + 1).alias("n"))
    return rounded(att.readout(q, m, "label", 64))


DEBYE = "-(31 * eta - 0.5 * ln(2 * pi() * 31) - 0.5 * ln(root) + ln(1 + (3 * tt - 5 * tt ** 3) / 24 / 31 + (81 * tt ** 2 - 462 * tt ** 4 + 385 * tt ** 6) / 1152 / 961))"


@query(f"""WITH k AS (SELECT vec_id, 1 + vec_id % 200 AS k FROM embeddings), z AS (SELECT *, sqrt(1 + (k / 31) * (k / 31)) AS root FROM k), e AS (SELECT *, 1 / root AS tt, root + ln((k / 31) / (1 + root)) AS eta FROM z)
  SELECT vec_id, round(31 * ln(k) - 32 * ln(2 * pi()) {DEBYE}, 6) AS log_normalizer FROM e""")
def vmf_debye_normalizer(spark, sf_dir):
    return rounded(t.table(spark, sf_dir, "embeddings").select("vec_id", vector.vmf_log_normalizer((1 + F.col("vec_id") % 200).cast("double"), 64).alias("log_normalizer")))


@query("SELECT vec_id, round(CASE WHEN r <= 0 THEN 0 ELSE least(100, r * (64 - r * r) / (1 - r * r)) END, 6) AS kappa FROM (SELECT vec_id, (vec_id % 100) / 100 AS r FROM embeddings)")
def vmf_kappa(spark, sf_dir):
    return rounded(t.table(spark, sf_dir, "embeddings").select("vec_id", vector.kappa(F.col("vec_id") % 100 / 100, 64).alias("kappa")))


def _memory(name: str, policy: memory.Policy):
    def f(spark, sf_dir):
        return memory.run_batch(t.memory_events(spark, sf_dir), policy)

    f.__name__ = name
    query()(f)


_memory("memory_threshold", memory.Policy(threshold=0.3))
_memory("memory_bank_strict", memory.Policy(threshold=0.3, strict=True, slots=64))
_memory("memory_adaptive", memory.Policy("quantile", threshold=0.3))
_memory("memory_vmf", memory.Policy("vmf"))
_memory("memory_temporal", memory.Policy("vmf", temporal=True))


@query()
def memory_bench(spark, sf_dir):
    """Read metrics of five policies: a read is right if it finds a record of its own label."""
    v = t.vectors(spark, sf_dir)
    policies = {"threshold": memory.Policy(threshold=0.3), "strict": memory.Policy(threshold=0.3, strict=True), "quantile": memory.Policy("quantile", threshold=0.3), "vmf": memory.Policy("vmf"), "temporal": memory.Policy("vmf", temporal=True)}
    done = memory.sweep(t.memory_events(spark, sf_dir), policies)
    reads = done.where("op = 'read'").select("config", F.col("seq"), F.posexplode("results").alias("rank", "source"))
    labels = v.select(F.col("id").cast("string").alias("source"), "label")
    own = v.select((F.col("id") * 2 + 1).alias("seq"), F.col("label").alias("expected"))
    each = reads.join(labels, "source").join(own, "seq").groupBy("config", "seq").agg(F.max(F.when((F.col("rank") == 0) & (F.col("label") == F.col("expected")), 1.0).otherwise(0.0)).alias("top1"), F.max(F.when(F.col("label") == F.col("expected"), 1.0).otherwise(0.0)).alias("recall"))
    return rounded(each.groupBy("config").agg(F.count("*").alias("reads"), F.avg("top1").alias("top1"), F.avg("recall").alias("recall")))


# --- streams and windows --------------------------------------------------------------------------------------------------------

TOK = """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), o AS (SELECT doc_id, w, coalesce(sum(len(w) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM w)"""


def _corpus(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    return lm_eval.global_offsets(d, "doc_id", F.size("w") + 1)


@query(TOK + " SELECT doc_id, o AS \"offset\" FROM o")
def corpus_offsets(spark, sf_dir):
    """Where each document starts if all are laid end to end with a separator."""
    return _corpus(spark, sf_dir).select("doc_id", F.col("offset").cast("long").alias("offset"))


@query(TOK + """, x AS (SELECT o + unnest(range(len(w) + 1)) AS position FROM o), n AS (SELECT max(position) + 1 AS n FROM x), s AS (SELECT position // (n // 4) AS stream, position % (n // 4) AS pos FROM x, n WHERE position < n // 4 * 4)
  SELECT stream::INT AS stream, (pos // 512)::INT AS window_index, count(*) AS tokens FROM s WHERE pos < (SELECT n // 4 - 1 FROM n) GROUP BY ALL""")
def sequential_windows(spark, sf_dir):
    """Four contiguous streams in windows of 512 tokens, each of which has a next one."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    return lm_eval.window_counts(t.table(spark, sf_dir, "documents").agg(F.sum(words + 1)), 4, 512)


STEP = "s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS x FROM events)"


@query(f"""WITH {STEP}, w AS (SELECT key, pos // 16 AS window_index, count(*) AS tokens, sum(abs(x)) AS nll FROM s GROUP BY ALL) SELECT window_index::INT AS window_index, sum(tokens)::BIGINT AS tokens, round(sum(nll) / sum(tokens), 6) AS nll, round(ln(exp(least(700, sum(nll) / sum(tokens)))), 6) AS log_perplexity FROM w GROUP BY ALL""")
def window_perplexity(spark, sf_dir):
    s = t.steps(spark, sf_dir).withColumn("nll", F.abs("x"))
    w = lm_eval.window_nll(s, 16, key="key")
    p = lm_eval.perplexity(w, ["window_index"])
    return rounded(p.select("window_index", "tokens", "nll", F.log("perplexity").alias("log_perplexity")))


@query(f"""WITH {STEP}, m AS (SELECT CASE key % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'memory' ELSE 'bank' END AS method, 16 AS window_size, pos // 16 AS window_index, abs(x) AS nll FROM s), f AS (SELECT method, window_size, sum(nll) AS nll FROM m WHERE window_index = 0 GROUP BY ALL)
  SELECT a.method, a.window_size, round(abs(a.nll - b.nll) / greatest(abs(b.nll), 1e-12), 6) AS difference, abs(a.nll - b.nll) / greatest(abs(b.nll), 1e-12) <= 1e-6 AS ok FROM f a JOIN f b ON b.method = 'base' AND a.method <> 'base'""")
def first_window_guard(spark, sf_dir):
    s = t.steps(spark, sf_dir).select(F.when(F.col("key") % 3 == 0, "base").when(F.col("key") % 3 == 1, "memory").otherwise("bank").alias("method"), F.lit(16).alias("window_size"), F.floor(F.col("pos") / 16).alias("window_index"), F.abs("x").alias("nll"))
    return rounded(lm_eval.first_window_guard(s))


@query(f"""WITH {STEP}, d AS (SELECT key, pos, x - lag(x) OVER (PARTITION BY key ORDER BY pos) AS dx, count(*) OVER (PARTITION BY key) AS n FROM s) SELECT key, CASE WHEN n = 1 THEN 0 ELSE pos - 1 END AS pos, round(coalesce(dx, 0), 6) AS dx FROM d WHERE pos > 0 OR n = 1""")
def momentum(spark, sf_dir):
    return rounded(trajectory.momentum(t.steps(spark, sf_dir)))


@query(f"""WITH {STEP}, r AS (SELECT key, list(x ORDER BY pos) AS xs, count(*) AS t FROM s GROUP BY key), i AS (SELECT key, xs, t, unnest(range(8)) AS i FROM r), p AS (SELECT *, least(greatest((i + 0.5) * t / 8 - 0.5, 0), t - 1)::DOUBLE AS src FROM i)
  SELECT key, i::INT AS pos, round(xs[floor(src)::INT + 1] * (1 - (src - floor(src))) + xs[least(floor(src)::INT + 1, t - 1) + 1] * (src - floor(src)), 6) AS x FROM p""")
def resample(spark, sf_dir):
    return rounded(trajectory.resample(t.steps(spark, sf_dir), 8))


@query()
def dtw_distance(spark, sf_dir):
    """Warping distance of each user's resampled trajectory to that of the next user."""
    r = trajectory.resample(t.steps(spark, sf_dir), 16).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: F.array(s["x"], F.lit(1.0))).alias("path"))
    pairs = r.alias("a").join(r.alias("b"), F.col("b.key") == F.col("a.key") + 1).select(F.col("a.key").alias("key"), F.col("a.path").alias("left"), F.col("b.path").alias("right"))
    return rounded(trajectory.dtw(pairs, 4).select("key", "distance"))


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_tumbling(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {STEP} SELECT key, pos, round(quantile_cont(x, 0.1) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING), 6) AS threshold FROM s""")
def event_rolling_quantile(spark, sf_dir):
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(-32, -1)
    return rounded(t.steps(spark, sf_dir).select("key", "pos", F.percentile("x", 0.1).over(w).alias("threshold")))


# --- text -----------------------------------------------------------------------------------------------------------------------

WORDS = "list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: w <> '')"


@query(f"""WITH c AS (SELECT conv_id, turn, {WORDS.format(c='text')} AS a, lead({WORDS.format(c='text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
  o AS (SELECT *, list_sum(list_transform(list_distinct(list_intersect(a, b)), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))) AS n FROM c WHERE b IS NOT NULL)
  SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2 * coalesce(n, 0) / (len(a) + len(b)) END, 6) AS f1 FROM o""")
def token_f1(spark, sf_dir):
    """Of each message and the next one of its conversation."""
    c = t.table(spark, sf_dir, "conversations").withColumn("a", text.words(F.col("text")))
    c = c.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return rounded(c.select("conv_id", "turn", text.token_f1(F.col("a"), F.col("b")).alias("f1")))


@query(f"SELECT conv_id, turn, round(len(list_distinct(w)) / greatest(len(w), 1), 6) AS ratio FROM (SELECT conv_id, turn, {WORDS.format(c='text')} AS w FROM conversations)")
def unique_ratio(spark, sf_dir):
    c = t.table(spark, sf_dir, "conversations")
    return rounded(c.select("conv_id", "turn", text.unique_ratio(text.words(F.col("text"))).alias("ratio")))


@query(f"""SELECT conv_id, turn, NOT (contains(text, 'Question:') OR contains(text, 'Answer:')) AND len(list_distinct(w)) / greatest(len(w), 1) >= 0.25 AS valid FROM (SELECT conv_id, turn, text, {WORDS.format(c='text')} AS w FROM conversations)""")
def history_quality(spark, sf_dir):
    c = t.table(spark, sf_dir, "conversations")
    marked = F.contains("text", F.lit("Question:")) | F.contains("text", F.lit("Answer:"))
    return c.select("conv_id", "turn", (~marked & (text.unique_ratio(text.words(F.col("text"))) >= 0.25)).alias("valid"))


@query("""WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS first, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body FROM documents),
  n AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(string_split(first, ' ')[1]), '\\s+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g') AS g, regexp_replace(trim(regexp_replace(lower(body), '\\s+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g') AS b FROM d)
  SELECT doc_id, g <> '' AND contains(b, g) AS found FROM n""")
def exact_gold(spark, sf_dir):
    """Whether a document's first word is in what follows its first line."""
    d = t.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.gold_in_body(F.split(F.split("text", "\n")[0], " ")[0], F.col("text")).alias("found"))


@query("""WITH c AS (SELECT conv_id, turn, string_split(text, ' ') AS a, lead(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
  SELECT conv_id, turn, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b)))::INT AS prefix FROM c WHERE b IS NOT NULL""")
def common_prefix(spark, sf_dir):
    c = t.table(spark, sf_dir, "conversations").withColumn("a", F.split("text", " "))
    c = c.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return c.select("conv_id", "turn", text.common_prefix(F.col("a"), F.col("b")).alias("prefix"))


def entry(spark: SparkSession) -> DataFrame:
    return knn_query_report(spark, "/root/testdata/sf0.001")
