"""Queries of banks, of reads of a tree as of a time, and of a memory's upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolith.functions.vector import dot, unit
from mnemolith.operators import asof, consolidate, upkeep
from mnemolith.plans import tables as t
from mnemolith.plans.queries import U, query, rounded
from mnemolith.streaming import banks

#: Streams of a thousand vectors, written in windows of fifty.
STREAM, WINDOW = 1000, 50


def _windows(spark, sf_dir):
    """Every vector is written, and every tenth asks at the start of its window."""
    v = t.vectors(spark, sf_dir).select(F.concat(F.lit("s"), F.floor(F.col("id") / STREAM).cast("string")).alias("stream"), F.lit(0).alias("layer"), F.lit("g").alias("grp"), F.floor(F.col("id") / WINDOW).cast("long").alias("win"), (F.col("id") * 2).alias("seq"), F.lit("write").alias("op"), F.col("vector").cast("array<double>").alias("vector"), F.slice("vector", 1, 4).cast("array<double>").alias("value"), F.col("id").cast("string").alias("source"))
    return v.unionByName(v.where(F.col("seq") % 20 == 0).withColumns({"op": F.lit("read"), "seq": F.col("seq") + 1, "value": F.lit(None).cast("array<double>")}))


def _shown(df):
    return rounded(df.withColumn("value", F.transform("value", lambda x: F.round(x, 6))))


@query()
def memory_bank_chunked(spark, sf_dir):
    """Records in slots found by the posterior, in chunks of 16, with budgets below what comes."""
    return _shown(banks.run_batch(_windows(spark, sf_dir), banks.BankPolicy(slots=64, records=300, chunk=16)))


@query()
def memory_bank_means(spark, sf_dir):
    """Means of keys and values, a window's familiar writes merged at once."""
    return _shown(banks.run_batch(_windows(spark, sf_dir), banks.BankPolicy("means", slots=64, threshold=0.3)))


W = """w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id AS id, label, label % 4 AS stream, embedding::DOUBLE[] AS x, embedding[1:4]::DOUBLE[] AS y FROM embeddings),
  e AS (SELECT stream, label AS slot, id, unnest(x) AS a, generate_subscripts(x, 1) AS i FROM w WHERE id % 2 = 0),
  s AS MATERIALIZED (SELECT * FROM (SELECT stream, slot, list(m ORDER BY i) AS key FROM (SELECT stream, slot, i, avg(a) AS m FROM e GROUP BY ALL) GROUP BY ALL) JOIN (SELECT label AS slot, count(*) AS n, label % 7 AS age FROM w WHERE id % 2 = 0 GROUP BY label) USING (slot)),
  b AS (SELECT w.stream, w.id, slot, round(list_cosine_similarity(x, key), 12) AS score FROM w JOIN s USING (stream) WHERE w.id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY round(list_cosine_similarity(x, key), 12) DESC, slot) = 1),
  j AS MATERIALIZED (SELECT w.stream, w.id, x, y, slot, score FROM w LEFT JOIN b USING (id) WHERE w.id % 2 = 1),
  k AS (SELECT stream, slot, i, sum(a) AS a, count(*) AS m FROM (SELECT stream, slot, unnest(x) AS a, generate_subscripts(x, 1) AS i FROM j WHERE score > 0.4) GROUP BY ALL),
  kv AS (SELECT stream, slot, i, sum(a) AS a FROM (SELECT stream, slot, unnest(y) AS a, generate_subscripts(y, 1) AS i FROM j WHERE score > 0.4) GROUP BY ALL),
  g AS MATERIALIZED (SELECT s.stream, s.slot, CASE WHEN min(k.m) IS NULL THEN any_value(s.key) ELSE list((s.key[k.i] * s.n + k.a) / (s.n + k.m) ORDER BY k.i) END AS key, s.n + coalesce(max(k.m), 0) AS n, CASE WHEN max(k.m) IS NULL THEN s.age + 1 ELSE 0 END AS age, max(k.m) IS NOT NULL AS touched
    FROM s LEFT JOIN k USING (stream, slot) GROUP BY s.stream, s.slot, s.n, s.age),
  gv AS (SELECT s.stream, s.slot, CASE WHEN count(kv.i) = 0 THEN any_value(s.key[1:4]) ELSE list((s.key[kv.i] * s.n + kv.a) / (s.n + (SELECT max(m) FROM k WHERE k.stream = s.stream AND k.slot = s.slot)) ORDER BY kv.i) END AS value FROM s LEFT JOIN kv USING (stream, slot) GROUP BY s.stream, s.slot),
  o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY id) - 1 AS r FROM j WHERE score IS NULL OR score <= 0.4),
  p AS (SELECT stream, slot, row_number() OVER (PARTITION BY stream ORDER BY CASE WHEN touched IS NULL THEN 0 WHEN NOT touched THEN 1 ELSE 2 END, CASE WHEN touched IS NULL OR touched THEN 0 ELSE -age END, slot) - 1 AS at
    FROM (SELECT DISTINCT stream FROM o) JOIN (SELECT unnest(range(40)) AS slot) ON true LEFT JOIN g USING (stream, slot)),
  tk AS (SELECT stream, slot, arg_max(x, r) AS x, arg_max(y, r) AS y FROM (SELECT o.stream, CASE WHEN r < 40 THEN p.slot ELSE r % 40 END AS slot, r, x, y FROM o JOIN p ON p.stream = o.stream AND p.at = o.r % 40) GROUP BY ALL)"""


@query(f"""WITH {W} SELECT stream, slot, round(key[1], 6) AS first_key, round(value[4], 6) AS last_value, n, age, CASE WHEN touched THEN 'merged' ELSE 'kept' END AS fate FROM g JOIN gv USING (stream, slot) WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.stream = g.stream AND tk.slot = g.slot)
  UNION ALL SELECT stream, slot, round(x[1], 6), round(y[4], 6), 1, 0, 'taken' FROM tk""")
def consolidated_means(spark, sf_dir):
    """Even ids made a slot for each label, in four streams of 40 places; odd ids are one window of writes."""
    v = t.vectors(spark, sf_dir).withColumn("stream", F.col("label") % 4)
    old = v.where("id % 2 = 0").select("stream", F.col("label").alias("slot"), F.posexplode("vector").alias("i", "x")).groupBy("stream", "slot", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    slots = old.groupBy("stream", "slot").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("key"), F.max("n").alias("n")).withColumns({"value": F.slice("key", 1, 4), "age": F.col("slot") % 7})
    writes = v.where("id % 2 = 1").select("stream", "id", F.col("vector").cast("array<double>").alias("key"), F.slice("vector", 1, 4).cast("array<double>").alias("value"))
    done = consolidate.consolidated(slots, writes, 0.4, 40)
    return rounded(done.select("stream", "slot", F.col("key")[0].alias("first_key"), F.col("value")[3].alias("last_value"), "n", "age", "fate"))


# --- a tree of slots as of each query's time --------------------------------------------------------------------------------------

#: A record is superseded by the one SPAN later.
SPAN = 150
TREE = f"""{U}, r AS (SELECT id AS record_id, label AS slot, 1000 + label % 4 AS parent, id AS write_time, lead(id) OVER (PARTITION BY id % {SPAN} ORDER BY id) AS superseded_at, x AS vector, exp(0.001 * id) AS w FROM u)"""


def _tree(spark, sf_dir):
    """Records of the embeddings, a leaf for each label, four parents, two roots."""
    r = t.vectors(spark, sf_dir).select(F.lit("s").alias("stream"), F.col("id").alias("record_id"), F.col("label").alias("slot"), F.col("id").cast("double").alias("write_time"), F.lead("id").over(t.by_order(F.col("id") % SPAN, "id")).alias("superseded_by"), unit(F.col("vector")).alias("vector"))
    r = r.withColumn("superseded_at", F.col("superseded_by").cast("double"))
    leaves = r.select("stream", F.col("slot").alias("node"), (1000 + F.col("slot") % 4).alias("parent")).distinct()
    parents = leaves.select("stream", F.col("parent").alias("node"), (2000 + F.col("parent") % 2).alias("parent")).distinct()
    roots = parents.select("stream", F.col("parent").alias("node"), F.lit(None).cast("long").alias("parent")).distinct()
    return r, leaves, parents, roots


@query(f"""WITH {TREE}, q AS (SELECT id AS query_id, x AS q, id * 0.75 AS as_of FROM u WHERE id % 100 = 0),
  seen AS MATERIALIZED (SELECT query_id, q, as_of, record_id, slot, parent, vector, w FROM q JOIN r ON write_time <= as_of AND (superseded_at IS NULL OR superseded_at > as_of)),
  d AS (SELECT query_id, parent, slot, unnest(vector) AS a, generate_subscripts(vector, 1) AS i, w FROM seen),
  ls AS (SELECT query_id, parent, slot, list(a ORDER BY i) AS s FROM (SELECT query_id, parent, slot, i, sum(a * w) AS a FROM d GROUP BY ALL) GROUP BY ALL),
  m AS (SELECT query_id, slot, sum(w) AS m FROM seen GROUP BY ALL),
  l AS MATERIALIZED (SELECT query_id, parent, slot, m, list_transform(s, lambda a: a / sqrt(list_dot_product(s, s))) AS c FROM ls JOIN m USING (query_id, slot)),
  pd AS (SELECT query_id, parent, m, unnest(c) AS a, generate_subscripts(c, 1) AS i FROM l), ps AS (SELECT query_id, parent, list(a ORDER BY i) AS s FROM (SELECT query_id, parent, i, sum(a * m) AS a FROM pd GROUP BY ALL) GROUP BY ALL),
  p AS (SELECT query_id, parent, list_transform(s, lambda a: a / sqrt(list_dot_product(s, s))) AS c FROM ps),
  n AS (SELECT query_id, parent FROM p JOIN q USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, c), 12) DESC, parent) <= 2),
  k AS (SELECT query_id, slot FROM n JOIN l USING (query_id, parent) JOIN q USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id, parent ORDER BY round(list_dot_product(q, c), 12) DESC, slot) <= 3),
  f AS (SELECT query_id, record_id, slot, round(list_dot_product(q, vector), 12) AS score FROM k JOIN seen USING (query_id, slot))
  SELECT query_id, record_id, slot, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id DESC) AS rank FROM f WHERE score >= 0.01 QUALIFY rank <= 4""")
def asof_routed_reads(spark, sf_dir):
    """Every hundredth vector asks how the tree was at three quarters of its own time: two parents, three leaves of each, four records."""
    r, leaves, parents, _ = _tree(spark, sf_dir)
    nodes = leaves.unionByName(parents.withColumn("parent", F.lit(None).cast("long")))
    q = r.where("record_id % 100 = 0").select("stream", F.col("record_id").alias("query_id"), F.col("vector").alias("q"), (F.col("record_id") * 0.75).cast("double").alias("as_of"))
    found = asof.asof_reads(q, r, nodes, F.exp(0.001 * F.col("write_time")), dot(F.col("q"), F.col("vector")), 2, 3, 4, least=0.01)
    return rounded(found.drop("stream"))


@query("""WITH RECURSIVE l AS (SELECT label AS node, 1000 + label % 4 AS parent FROM embeddings GROUP BY label), n AS (SELECT * FROM l UNION SELECT parent, 2000 + parent % 2 FROM l UNION SELECT 2000 + parent % 2, NULL FROM l),
  k AS (SELECT DISTINCT label AS node FROM embeddings WHERE vec_id >= (SELECT max(vec_id) FROM embeddings) - 6),
  up AS (SELECT n.* FROM n JOIN k USING (node) UNION SELECT n.* FROM up JOIN n ON n.node = up.parent) SELECT node, parent FROM up""")
def pruned_nodes(spark, sf_dir):
    """What stays of a tree of three levels once all but the last records are gone."""
    r, leaves, parents, roots = _tree(spark, sf_dir)
    last = r.agg(F.max("record_id").alias("last"))
    held = r.join(F.broadcast(last), F.col("record_id") >= F.col("last") - 6).select("stream", "slot").distinct()
    return asof.kept_nodes(leaves.unionByName(parents).unionByName(roots), held).select("node", "parent")


@query()
def memory_maintained(spark, sf_dir):
    """What two rounds of upkeep do to the tree: records that are superseded go, then the least useful until the budget holds, leaves are split and merged."""
    r, leaves, parents, _ = _tree(spark, sf_dir)
    records = r.select("stream", "record_id", "slot", "vector", F.slice("vector", 1, 8).alias("value"), "write_time", F.lit(None).cast("double").alias("last_used"), (F.col("record_id") % 3).alias("reads"), (1.0 / (1 + F.col("record_id") % 5)).cast("double").alias("gain"), "superseded_by", F.lit(1000).cast("long").alias("size"))
    node = lambda df, leaf: df.select("stream", "node", "parent", F.lit(leaf).alias("leaf"), F.lit(0).alias("pending"), F.lit(0.0).alias("cooldown_until"), F.lit(0.0).alias("regret"))
    nodes = node(leaves, True).unionByName(node(parents.withColumn("parent", F.lit(None).cast("long")), False))
    m = upkeep.Memory(records, nodes, spark.createDataFrame([], upkeep.COST))
    now, said = r.agg(F.max("write_time")).first()[0], []
    rules = upkeep.Upkeep(age_decay=1e-4, least_weight=1e-3, budget=120_000, budget_step=1e-15, split_least_gain=0.05, slot_penalty=0.5, patience=2, merge_least_similarity=0.2)
    for turn in range(2):
        m, report = upkeep.maintain(m, now + turn, rules)
        said.append(report.withColumn("round", F.lit(turn)))
    return said[0].unionByName(said[1]).drop("stream")
