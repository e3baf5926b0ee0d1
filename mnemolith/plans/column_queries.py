"""Queries of column functions, filters and row builders, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemolith.functions import text, vector
from mnemolith.operators import attention as att
from mnemolith.operators import hierarchy, lm_eval, planning, prepare, retrieval, similarity, temporal, trajectory
from mnemolith.plans import tables as t
from mnemolith.plans import runner
from mnemolith.plans.io_queries import ITEMS, _folder, _tree
from mnemolith.plans.queries import ATT, REC, S, STEP, U, V, WORDS, _corpus, query, rounded
from mnemolith.session import cut
from mnemolith.sources import files

# --- text -----------------------------------------------------------------------------------------------------------------------

ONE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {ONE} AS line, lower({ONE}) AS question_key FROM conversations")
def one_line_text(spark, sf_dir):
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.one_line(F.col("text")).alias("line"), text.question_key(F.col("text")).alias("question_key"))


@query(f"""SELECT conv_id, turn, trim(role || ': ' || {ONE}) AS collapsed, trim(role || ': ' || text) AS kept, trim('Turn: ' || {ONE}) AS nameless FROM conversations""")
def speaker_lines(spark, sf_dir):
    c, no = t.table(spark, sf_dir, "conversations"), F.lit("")
    line = lambda role, collapse: text.message_text(no, role, F.col("text"), no, collapse)
    return c.select("conv_id", "turn", line(F.col("role"), True).alias("collapsed"), line(F.col("role"), False).alias("kept"), line(no, True).alias("nameless"))


@query("""SELECT conv_id, turn, lower(trim(string_split(trim(text), chr(10))[1])) = lower(trim(CASE WHEN turn % 3 = 0 THEN text ELSE ' ' || string_split(text, chr(10))[1] END)) AS ok FROM conversations""")
def first_line_match(spark, sf_dir):
    answer = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit(" "), F.split("text", "\n")[0]))
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.first_line_matches(F.col("text"), answer).alias("ok"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents) SELECT doc_id, least(16, len(w), coalesce(nullif(list_position(w, 'the'), 0), len(w)))::INT AS n FROM w""")
def answer_block_end(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").withColumn("w", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    return d.select("doc_id", text.block_end(F.col("w"), F.lit("the"), 16).alias("n"))


@query("""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), o AS (SELECT conv_id, turn, list_transform(range(1, len(w) + 1), lambda i: {'a': length(array_to_string(w[1 : i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END, 'n': length(w[i])}) AS o FROM w),
  h AS (SELECT conv_id, turn, list_filter(range(1, len(o) + 1), lambda i: o[i].a + o[i].n > 10 AND o[i].a < 25) AS h FROM o) SELECT conv_id, turn, (list_min(h) - 1)::INT AS first, list_max(h)::INT AS after FROM h""")
def token_spans(spark, sf_dir):
    """Tokens parted by single blanks that overlap the characters 10 to 25."""
    w = F.split("text", " ")
    starts = F.transform(w, lambda x, i: F.length(F.array_join(F.slice(w, F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0))
    offsets = F.zip_with(starts, w, lambda s, x: F.struct(s.alias("start"), (s + F.length(x)).alias("end")))
    span = text.token_span(offsets, F.lit(10), F.lit(25))
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", span.alias("s")).select("conv_id", "turn", F.col("s.first").alias("first"), F.col("s.end").alias("after"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), n AS (SELECT doc_id, w, [w[-2], w[-1]] AS x FROM w WHERE len(w) >= 2)
  SELECT doc_id, list_max(list_filter(range(len(w) - 1), lambda i: w[i + 1] = 'the' AND w[i + 2] = 'of'))::INT AS at FROM n""")
def last_subsequence(spark, sf_dir):
    """Where ``the of`` stands for the last time; null if nowhere."""
    d = t.table(spark, sf_dir, "documents").withColumn("w", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).where(F.size("w") >= 2)
    return d.select("doc_id", F.nullif(text.find_last(F.col("w"), F.array(F.lit("the"), F.lit("of"))), F.lit(-1)).alias("at"))


@query("""WITH w AS (SELECT conv_id, turn, list_transform(range(0, (length(text) + 4) // 5), lambda i: substr(text, i * 5 + 1, 5)) AS w, text FROM conversations)
  SELECT conv_id, turn, (nullif(instr(text, chr(10)), 0) - 1)::INT // 5 AS line_end, CASE WHEN length(ltrim(text)) >= 3 THEN (length(text) - length(ltrim(text)) + 2) // 5 END::INT AS prefix_end FROM w""")
def prefix_ends(spark, sf_dir):
    """Tokens of five characters: the one that ends the first line, and the one up to which the text begins with its first three characters."""
    c = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.regexp_extract_all("text", F.lit("(?s).{1,5}"), F.lit(0)).alias("w"))
    first = F.substring(F.ltrim("text"), 1, 3)
    return c.select("conv_id", "turn", text.prefix_end(F.col("w"), lambda x: F.contains(x, F.lit("\n"))).alias("line_end"), F.when(F.length(first) == 3, text.prefix_end(F.col("w"), lambda x: F.startswith(F.ltrim(x), first))).alias("prefix_end"))


@query("""SELECT conv_id, turn, regexp_replace(regexp_replace(substr(text, 1, 30), '[^\\p{L}\\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g') AS name, trim(substr(text, 1, 30)) <> '' AND NOT regexp_matches(trim(substr(text, 1, 30)), '^[/\\\\]|^[A-Za-z]:[/\\\\]|^\\.\\.?[/\\\\]') AS repository FROM conversations""")
def safe_names(spark, sf_dir):
    head = F.substring("text", 1, 30)
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.safe_name(head).alias("name"), text.repository_id(head).alias("repository"))


INS, MARK = (x.replace("'", "''") for x in (text.KNOWLEDGE_INSTRUCTION, text.INPUT_MARK))


@query(f"""SELECT conv_id, turn, md5('{INS}{MARK}' || text) AS added, md5(rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) || '{INS}') AS appended, md5('{INS}{MARK}' || text) AS refreshed FROM conversations""")
def prompt_instructions(spark, sf_dir):
    c, p = t.table(spark, sf_dir, "conversations"), F.col("text")
    old = F.concat(F.lit("Another instruction." + text.INPUT_MARK), p)
    return c.select("conv_id", "turn", F.md5(text.with_instruction(p)).alias("added"), F.md5(text.followed_by_instruction(p)).alias("appended"), F.md5(text.refreshed_instruction(old)).alias("refreshed"))


@query()
def sequence_ratios(spark, sf_dir):
    """Of each message and the next one of its conversation, whole."""
    c = t.table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next IS NOT NULL")
    return c.select("conv_id", "turn", text.sequence_ratio(F.col("text"), F.col("next")).alias("ratio"))


F1 = f"""WITH c AS (SELECT conv_id, turn, role, text, {WORDS.format(c='text')} AS a, lead({WORDS.format(c='text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
  o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(a, b)), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) AS n FROM c WHERE b IS NOT NULL),
  q AS (SELECT conv_id, turn, role, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2 * n / (len(a) + len(b)) END AS f1, contains(text, 'Question:') OR contains(text, 'Answer:') AS marked, len(list_distinct(a)) / greatest(len(a), 1) AS ratio FROM o)"""


def _history(spark, sf_dir):
    c = t.table(spark, sf_dir, "conversations").withColumn("a", text.words(F.col("text")))
    c = c.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    marked = F.contains("text", F.lit("Question:")) | F.contains("text", F.lit("Answer:"))
    return c.select("conv_id", "turn", "role", text.token_f1(F.col("a"), F.col("b")).alias("f1"), marked.alias("marked"), text.unique_ratio(F.col("a")).alias("ratio"))


@query(F1 + " SELECT conv_id, turn, round(f1, 6) AS f1, NOT marked AND ratio >= 0.25 AND f1 > 0 AS valid FROM q")
def history_payload(spark, sf_dir):
    """Of each message, the next one being the gold answer."""
    return rounded(_history(spark, sf_dir).select("conv_id", "turn", "f1", (~F.col("marked") & (F.col("ratio") >= 0.25) & (F.col("f1") > 0)).alias("valid")))


@query(F1 + " SELECT role, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(avg(CASE WHEN f1 > 0.1 THEN 1.0 ELSE 0 END), 6) AS rate, round(avg(ratio), 6) AS mean_ratio FROM q GROUP BY role")
def replay_summary(spark, sf_dir):
    h = _history(spark, sf_dir)
    return rounded(h.groupBy("role").agg(F.count("*").alias("n"), F.avg("f1").alias("mean_f1"), F.avg(F.when(F.col("f1") > 0.1, 1.0).otherwise(0.0)).alias("rate"), F.avg("ratio").alias("mean_ratio")))


# --- vectors --------------------------------------------------------------------------------------------------------------------


@query(f"WITH {V} SELECT a.id, round(greatest(0, 1 - list_cosine_similarity(a.x, b.x)), 6) AS cosine_distance, round(list_distance(a.x, b.x) ** 2, 6) AS squared FROM v a JOIN v b ON b.id = a.id + 1")
def vector_distances(spark, sf_dir):
    """Of each vector to the next one."""
    v = t.vectors(spark, sf_dir)
    pairs = v.select("id", "vector").join(v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other")), "id")
    return rounded(pairs.select("id", vector.cosine_distance(F.col("vector"), F.col("other")).alias("cosine_distance"), vector.squared_distance(F.col("vector"), F.col("other")).alias("squared")))


@query(f"WITH {V}, p AS (SELECT id, unnest(list_transform({vector.projection_signs(64, 4, 7)}, lambda r: list_dot_product(x, r::DOUBLE[]) / 2)) AS value, generate_subscripts(range(4), 1) - 1 AS dim FROM v) SELECT id, dim::INT AS dim, round(value, 6) AS value FROM p")
def random_projections(spark, sf_dir):
    v = t.vectors(spark, sf_dir)
    return rounded(v.select("id", F.posexplode(vector.random_projection(F.col("vector"), 64, 4, 7)).alias("dim", "value")))


@query(ATT + " SELECT sample_id, round(max(score) + ln(sum(exp(score - m))), 6) AS value FROM (SELECT sample_id, score, max(score) OVER (PARTITION BY sample_id) AS m FROM cand) GROUP BY sample_id")
def score_logsumexp(spark, sf_dir):
    c = t.candidates(spark, sf_dir).withColumn("value", vector.logsumexp(F.col("score"), "sample_id"))
    return rounded(c.select("sample_id", "value").groupBy("sample_id").agg(F.max("value").alias("value")))


@query("SELECT vec_id, round(CASE WHEN k = 0 THEN -ln(4 * pi()) ELSE ln(k) - ln(4 * pi()) - (k + ln((1 - exp(-2 * k)) / 2)) + k * c END, 6) AS log_density FROM (SELECT vec_id, (vec_id % 60)::DOUBLE AS k, (vec_id % 21 - 10) / 10 AS c FROM embeddings)")
def vmf_density_on_sphere(spark, sf_dir):
    """On the sphere in three dimensions, where the density has a closed form."""
    e = t.table(spark, sf_dir, "embeddings")
    return rounded(e.select("vec_id", vector.vmf_log_density((F.col("vec_id") % 21 - 10) / 10, (F.col("vec_id") % 60).cast("double"), 3).alias("log_density")))


SPHERE = math.lgamma(32) - math.log(2) - 32 * math.log(math.pi)
VMF = f"""(CASE WHEN k <= 1e-8 THEN {SPHERE} ELSE 31 * ln(k) - 32 * ln(2 * pi()) - (31 * (root + ln((k / 31) / (1 + root))) - 0.5 * ln(2 * pi() * 31) - 0.5 * ln(root) + ln(1 + (3 / root - 5 / root ** 3) / 24 / 31 + (81 / root ** 2 - 462 / root ** 4 + 385 / root ** 6) / 1152 / 961)) END)"""


@query(f"""WITH {U}, d AS (SELECT label, unnest(x) AS a, generate_subscripts(x, 1) AS dim FROM u), s AS (SELECT label, dim, sum(a) AS s FROM d GROUP BY ALL), l AS (SELECT label AS slot, list(s ORDER BY dim) AS s, sqrt(sum(s * s)) AS norm FROM s GROUP BY label),
  c AS (SELECT label AS slot, count(*) AS n FROM u GROUP BY label), z AS (SELECT slot, n, s, norm, norm / (n + 1) AS r FROM l JOIN c USING (slot)), y AS (SELECT *, least(100, r * (64 - r * r) / (1 - r * r)) AS k FROM z), w AS (SELECT *, sqrt(1 + (k / 31) ** 2) AS root FROM y),
  q AS (SELECT u.id, slot, 0.5 * ln(n) + {VMF} + k * list_dot_product(u.x, s) / norm AS score FROM u JOIN w ON u.id % 100 = 0 AND u.label % 4 = slot % 4 UNION ALL SELECT id, -1, ln(0.1) + {SPHERE} FROM u WHERE id % 100 = 0),
  e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM q) SELECT id, slot, round(e / sum(e) OVER (PARTITION BY id), 6) AS p FROM e""")
def assignment_posterior(spark, sf_dir):
    """Of every hundredth vector: how likely it is of each slot of its group, or of a new one (-1)."""
    r = t.records(spark, sf_dir)
    slots = temporal.slot_statistics(r, 64).select("slot", "records", "concentration", "resultant", "mass")
    centres = temporal.centroids(r, ["slot"]).groupBy("slot").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("mean"))
    return rounded(temporal.assignment_posterior(r.where("record_id % 100 = 0").select(F.col("record_id").alias("id"), (F.col("slot") % 4).alias("grp"), "vector"), slots.join(centres, "slot").withColumn("grp", F.col("slot") % 4), 64, alpha=0.1, exponent=0.5))


# --- memory records -------------------------------------------------------------------------------------------------------------


@query(f"WITH {STEP} SELECT key, round(list_reduce(list(x ORDER BY pos), lambda s, v: s * 0.9 + v * 0.1, 0.0), 6) AS ema FROM s GROUP BY key")
def event_ema(spark, sf_dir):
    s = t.steps(spark, sf_dir).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias("xs"))
    return rounded(s.select("key", temporal.ema_fold(F.col("xs"), 0.1).alias("ema")))


READS = """WITH r AS (SELECT label % 3 AS scenario, vec_id % 50 = 0 AS absent, [vec_id, vec_id + 1]::BIGINT[] AS expected, [vec_id + 2]::BIGINT[] AS stale,
    CASE vec_id % 40 WHEN 0 THEN []::BIGINT[][] WHEN 10 THEN [[vec_id]]::BIGINT[][] WHEN 20 THEN [[vec_id, vec_id + 2], [vec_id + 1]]::BIGINT[][] ELSE [[vec_id + 5], [vec_id + 1]]::BIGINT[][] END AS results FROM embeddings WHERE vec_id % 10 = 0),
  f AS (SELECT scenario, absent, len(results) > 0 AS found, len(results) > 0 AND len(list_intersect(results[1], expected)) > 0 AND len(list_filter(results[1], lambda s: NOT list_contains(expected, s))) = 0 AS top1,
    len(list_filter(results, lambda x: len(list_intersect(x, expected)) > 0)) > 0 AS hit, len(list_filter(results, lambda x: len(list_intersect(x, stale)) > 0)) > 0 AS st, len(list_filter(results, lambda x: len(list_filter(x, lambda s: NOT list_contains(expected, s))) > 0)) > 0 AS bad FROM r)"""


@query(READS + """ SELECT scenario, count(*) AS queries, round(coalesce(avg(top1::INT) FILTER (NOT absent), 0), 6) AS top1_accuracy, round(coalesce(avg(hit::INT) FILTER (NOT absent), 0), 6) AS recall_at_k, round(coalesce(avg((NOT found)::INT) FILTER (absent), 0), 6) AS absent_abstention,
  round(avg(CASE WHEN absent THEN found ELSE bad END::INT), 6) AS wrong_injection_rate, round(coalesce(avg(st::INT) FILTER (NOT absent), 0), 6) AS stale_injection_rate FROM f GROUP BY scenario""")
def read_metrics(spark, sf_dir):
    """Rates of made-up reads of every kind: right, partly right, stale, wrong, empty, absent."""
    i = F.col("id")
    results = F.when(i % 40 == 0, F.array().cast("array<array<bigint>>")).when(i % 40 == 10, F.array(F.array(i))).when(i % 40 == 20, F.array(F.array(i, i + 2), F.array(i + 1))).otherwise(F.array(F.array(i + 5), F.array(i + 1)))
    r = t.vectors(spark, sf_dir).where(i % 10 == 0).select((F.col("label") % 3).alias("scenario"), (i % 50 == 0).alias("absent"), F.array(i, i + 1).alias("expected"), F.array(i + 2).alias("stale"), results.alias("results"))
    return rounded(temporal.read_metrics(r, "scenario"))


GROUPED = REC.replace("PARTITION BY label ORDER BY id", "PARTITION BY id % 7 ORDER BY id")


@query(GROUPED + " SELECT DISTINCT a.slot, b.slot AS other FROM w a JOIN w b ON a.superseded_by = b.record_id AND a.slot <> b.slot")
def cross_supersession(spark, sf_dir):
    """Every seventh record is one conflict group."""
    r = t.records(spark, sf_dir).drop("superseded_by", "superseded_at").withColumn("conflict_group", F.col("record_id") % 7)
    return temporal.cross_supersession(temporal.supersede_by_group(r))


@query(f"WITH {V} SELECT label AS slot, count(*) AS n, count(DISTINCT x) = 1 AS one_text, list_sort(list(DISTINCT id % 9)) AS sources FROM v GROUP BY label")
def centroid_payload(spark, sf_dir):
    return temporal.centroid_payload(t.records(spark, sf_dir).withColumn("source", F.col("record_id") % 9))


@query(f"""WITH {U}, d AS (SELECT label, id % 2 AS half, unnest(x) AS a, generate_subscripts(x, 1) AS dim FROM u), m AS (SELECT label, half, dim, avg(a) AS a FROM d GROUP BY ALL), c AS (SELECT label, half, list(a ORDER BY dim) AS c FROM m GROUP BY ALL),
  n AS (SELECT label, list_transform(c, lambda z: z / sqrt(list_dot_product(c, c))) AS c FROM c), s AS (SELECT u.label, u.id, max(list_dot_product(u.x, n.c)) AS c FROM u JOIN n USING (label) GROUP BY ALL)
  SELECT label AS slot, round(avg(1 - c), 6) AS regret FROM s GROUP BY label""")
def slot_regret(spark, sf_dir):
    """With two centres for each slot: of its even and of its odd records."""
    r = t.records(spark, sf_dir)
    halves = temporal.centroids(r.withColumn("half", F.col("record_id") % 2), ["slot", "half"])
    centres = halves.groupBy("slot", "half").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("c")).select("slot", vector.unit(F.col("c")).alias("centre"))
    return rounded(temporal.regret(r.select("slot", "record_id", "vector"), centres))


@query(f"""WITH {U}, p AS (SELECT id AS record_id, 100 + id % 50 AS size, (id % 4 + 1.0) / (1000 - least(id, 1000) + id % 4 + 1.0) * exp(-0.001 * (1000 - least(id, 1000))) * (id % 5) / (100 + id % 50) AS priority FROM u),
  l AS (SELECT *, sum(size) OVER () - coalesce(sum(size) OVER (ORDER BY priority, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM p) SELECT record_id, round(priority, 6) AS priority FROM l WHERE left_ > 10000""")
def eviction(spark, sf_dir):
    """Records that go until the rest takes 10,000 bytes."""
    i = F.col("record_id")
    at = F.least(i, F.lit(1000)).cast("double")
    p = temporal.eviction_priority(F.lit(1000.0), at, F.lit(None).cast("double"), (i % 4).cast("double"), (i % 5).cast("double"), 100 + i % 50, 0.001)
    r = t.records(spark, sf_dir).select("stream", "record_id", (100 + i % 50).alias("size"), p.alias("priority"))
    return rounded(temporal.evicted(r, 10_000).select("record_id", "priority"))


@query("SELECT vec_id AS slot, row_number() OVER (PARTITION BY vec_id % 3 ORDER BY CASE WHEN vec_id % 5 = 0 THEN 0 WHEN vec_id % 2 = 0 THEN 1 ELSE 2 END, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE -(vec_id % 17) END, vec_id) AS rank FROM embeddings")
def allocation_order(spark, sf_dir):
    i = F.col("id")
    return temporal.allocation_order(t.vectors(spark, sf_dir).select((i % 3).alias("stream"), i.alias("slot"), (i % 5 != 0).alias("used"), (i % 2 != 0).alias("touched_now"), (i % 17).alias("age"))).select("slot", "rank")


@query(f"""WITH {U}, p AS (SELECT a.id, 1 - list_dot_product(a.x, b.x) + 0.5 * (1 - list_dot_product(a.x, b.x)) + 0.25 * 1 / greatest(1, 5000 - a.id) AS d FROM u a JOIN u b ON b.id = a.id + 1 AND a.label = b.label) SELECT id, round(d, 6) AS d FROM p""")
def split_distances(spark, sf_dir):
    """Of each record to the next one, where both are of a slot."""
    r = t.records(spark, sf_dir).select(F.col("record_id").alias("id"), "slot", "vector", "value", "write_time")
    o = r.select((F.col("id") - 1).alias("id"), "slot", F.col("vector").alias("v2"), F.col("value").alias("x2"), F.col("write_time").alias("t2"))
    d = temporal.split_distance(F.col("vector"), F.col("v2"), F.col("value"), F.col("x2"), F.col("write_time"), F.col("t2"), F.lit(5000.0), 0.5, 0.25)
    return rounded(r.join(o, ["id", "slot"]).select("id", d.alias("d")))


@query(f"""WITH {V}, r AS (SELECT sum(160 + 8 * 3 * len(x))::BIGINT AS b FROM v), s AS (SELECT sum(192 + 8 * (64 + n))::BIGINT AS b FROM (SELECT count(*) AS n FROM v GROUP BY label)), p AS (SELECT sum(160 + 8 * (64 + n))::BIGINT AS b FROM (SELECT count(DISTINCT label) AS n FROM v GROUP BY label % 4))
  SELECT r.b AS record_bytes, s.b AS slot_bytes, p.b AS parent_bytes, r.b + s.b + p.b AS bytes FROM r, s, p""")
def memory_tree_bytes(spark, sf_dir):
    """With a parent for each fourth of the slots."""
    r = t.records(spark, sf_dir)
    flat = temporal.memory_bytes(r, r.groupBy("slot").agg(F.count("*").alias("records")).withColumn("dims", F.lit(64)))
    parents = temporal.parent_bytes(r.groupBy((F.col("slot") % 4).alias("p")).agg(F.count_distinct("slot").alias("children")).withColumn("dims", F.lit(64)))
    return flat.crossJoin(F.broadcast(parents)).select("record_bytes", "slot_bytes", "parent_bytes", (F.col("bytes") + F.col("parent_bytes")).alias("bytes"))  # one row each


# --- filters and sets -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id, 'missing' AS fault FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def key_faults(spark, sf_dir):
    """Documents without a label, labels without a document."""
    d, lab = (t.table(spark, sf_dir, n).select(F.col("doc_id").alias("id")) for n in ("documents", "labels"))
    return prepare.key_faults(d, lab, "id")


@query("SELECT lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1")
def first_of_each(spark, sf_dir):
    return prepare.keep_first(t.table(spark, sf_dir, "documents"), ["lang", "source"], F.desc("n_chars"), F.asc("doc_id")).select("lang", "source", "doc_id")


@query("WITH c AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id FROM c WHERE conv_id % 3 <> 0 AND conv_id % 4 <= last")
def whole_evidence(spark, sf_dir):
    """Questions of some turns: none, one that is there, or one that may not be."""
    c = t.table(spark, sf_dir, "conversations")
    qa = c.select("conv_id").distinct().select(F.col("conv_id").alias("index"), F.col("conv_id").alias("user_name"), F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("long"), F.col("conv_id") % 4)).alias("evidence_turn_ids"))
    return prepare.with_whole_evidence(qa, c.select(F.col("conv_id").alias("user_name"), F.col("turn").cast("long").alias("turn_id"))).select(F.col("index").alias("conv_id"))


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 3, 4, 5)")
def chosen_indices(spark, sf_dir):
    return t.table(spark, sf_dir, "embeddings").where(F.col("label").isin(*text.parse_indices("1,3-5"))).select("vec_id")


@query("SELECT event_type, count(*) FILTER (event_id % 5 > 1) AS n, round(avg(value) FILTER (event_id % 5 > 1), 6) AS mean FROM events GROUP BY event_type")
def finite_means(spark, sf_dir):
    """A fifth of the values is infinite and a fifth no number: they don't count."""
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).when(F.col("event_id") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return rounded(retrieval.finite_means(t.table(spark, sf_dir, "events").select("event_type", v.alias("value")), ["event_type"], "value"))


@query(ATT + """, s AS (SELECT sample_id, sum(mass) AS m FROM cand GROUP BY sample_id) SELECT sample_id, 'not a distribution' AS fault FROM s WHERE sample_id % 3 = 1 UNION ALL SELECT sample_id, f FROM s, (VALUES ('block in window'), ('horizon')) t(f) WHERE sample_id % 3 = 2""")
def sample_faults(spark, sf_dir):
    """A third of the samples is sound, a third has halved shares, a third a block inside its window and no horizon."""
    i = F.col("sample_id")
    c = t.candidates(spark, sf_dir).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("cand_index", "end_position", "mass"))).alias("c"))
    get = lambda n: F.transform("c", lambda x: x[n])
    s = c.select(
        i.cast("string").alias("sample_id"), F.lit("s").alias("sequence_id"), F.lit(40).alias("local_start"), F.lit(50).alias("local_end"), F.lit(49).alias("retrieval_position"), F.lit(50).alias("first_future_position"), F.when(i % 3 == 2, 0).otherwise(8).alias("horizon"),
        F.array(F.lit(1.0), F.lit(2.0)).alias("query"), get("cand_index").alias("ids"), F.transform(get("end_position"), lambda x: x + F.when(i % 3 == 2, 8).otherwise(0)).alias("ends"), F.transform("c", lambda x: F.array(F.lit(1.0), F.lit(0.5))).alias("vectors"),
        get("mass").alias("absolute"), F.aggregate(get("mass"), F.lit(0.0), lambda a, x: a + x).alias("total"), F.transform(get("mass"), lambda x: x / F.when(i % 3 == 1, 2).otherwise(1)).alias("conditional"),
    )
    return att.sample_faults(s).select(F.col("sample_id").cast("long").alias("sample_id"), "fault")


@query("SELECT DISTINCT doc_id::VARCHAR AS prompt_id, f AS fault FROM documents, (VALUES ('suite'), ('instructed')) t(f) WHERE (f = 'suite' AND lang = 'de') OR (f = 'instructed' AND doc_id % 10 = 0) UNION ALL SELECT NULL, 'question_query'")
def prompt_faults(spark, sf_dir):
    """German ones are of another suite, every tenth holds an instruction, and there are no queries."""
    d = t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("prompt_id"), F.when(F.col("lang") == "de", "other").otherwise("convomem_query_to_fact").alias("suite"), (F.col("doc_id") % 10 == 0).alias("knowledge_prompt"), F.lit("fact_reference").alias("condition_id"))
    return prepare.prompt_faults(d)


# --- attention, windows, blocks -------------------------------------------------------------------------------------------------


@query(ATT + " SELECT sample_id, layer::INT AS layer, head::INT AS head, future_index::INT AS future_index, (key_position // 8)::INT AS block_index, round(sum(p), 6) AS mass FROM a GROUP BY ALL")
def head_future_mass(spark, sf_dir):
    return rounded(att.future_mass_by_head(t.attention(spark, sf_dir), t.BLOCK).withColumns({c: F.col(c).cast("int") for c in ("layer", "head", "future_index")}))


@query(ATT + """, g AS (SELECT * FROM (VALUES ('fact', 0, 5), ('fact', 10, 12), ('suffix', 30, 99)) t(region, lo, hi)) SELECT sample_id, layer::INT AS layer, head::INT AS head, future_index::INT AS future_index, region, CASE region WHEN 'fact' THEN 7 ELSE 10 END AS length, round(sum(p), 6) AS mass
  FROM a JOIN g ON key_position >= lo AND key_position < hi GROUP BY ALL""")
def region_mass(spark, sf_dir):
    a = cut(t.attention(spark, sf_dir))
    ranges = F.array(*[F.struct(F.lit(r).alias("region"), F.lit(s).alias("start_position"), F.lit(e).alias("end_position")) for r, s, e in (("fact", -3, 5), ("fact", 10, 12), ("suffix", 30, 99), ("beyond", 50, 60))])
    regions = a.select("sample_id").distinct().select("sample_id", F.inline(ranges))
    return rounded(att.region_mass(a, regions, t.KEYS).select("sample_id", *[F.col(c).cast("int").alias(c) for c in ("layer", "head", "future_index")], "region", F.col("length").cast("int").alias("length"), "mass"))


@query(ATT + """, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_index) AS rank FROM cand) SELECT sample_id, cand_index, row_number() OVER (PARTITION BY sample_id ORDER BY start_position) AS place FROM r WHERE rank <= 3""")
def top_blocks_in_place(spark, sf_dir):
    """The three best blocks, in the order in which they stand."""
    best = retrieval.select_top(t.candidates(spark, sf_dir), "learned", 3)
    return best.select("sample_id", "cand_index", F.row_number().over(Window.partitionBy("sample_id").orderBy("start_position")).alias("place"))


@query(f"""WITH {STEP}, n AS (SELECT key AS stream, pos, lead(floor(x)::BIGINT) OVER (PARTITION BY key ORDER BY pos) AS target FROM s) SELECT stream, pos, target, (pos // 16)::INT AS window_index, (pos % 16)::INT AS place FROM n WHERE target IS NOT NULL""")
def next_token_windows(spark, sf_dir):
    s = t.steps(spark, sf_dir).select(F.col("key").alias("stream"), "pos", F.floor("x").alias("token_id"))
    return lm_eval.windows(s, 16).select("stream", "pos", "target", "window_index", "place")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 512 ELSE event_id * 7 END AS "offset" FROM events""")
def window_offsets(spark, sf_dir):
    i = F.col("event_id")
    method, policy = F.when(i % 2 == 0, "base").otherwise("memory"), F.when(i % 3 == 0, "window_reset").when(i % 3 == 1, "cache_relative").otherwise("continuous")
    return t.table(spark, sf_dir, "events").select("event_id", lm_eval.position_offset(method, policy, i % 5, i * 7, F.lit(512)).alias("offset"))


@query("SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) - n * INTERVAL '15 minutes' AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, range(4) r(n) GROUP BY ALL")
def event_sliding(spark, sf_dir):
    """Windows of an hour, one each quarter."""
    e = t.table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour", "15 minutes")["start"].alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT doc_id, i::INT AS place, p::INT AS position, f AS family FROM documents, LATERAL (SELECT unnest(range(n_chars % 7)) AS i), LATERAL (SELECT 5 + i AS p), (VALUES ('answer')) t(f) UNION ALL SELECT doc_id, -1, 4, 'final_prompt' FROM documents")
def position_lists(spark, sf_dir):
    """A prompt of five tokens and an answer of some."""
    d = t.table(spark, sf_dir, "documents").select("doc_id", F.inline(planning.answer_positions(F.lit(5), (5 + F.col("n_chars") % 7).cast("int"))))
    return d.select("doc_id", "place", "position", "family")


@query(f"""WITH {S}, p AS (SELECT sequence_id, unnest([95, 130]) AS p FROM s WHERE n_tokens >= 145) SELECT sequence_id || ':' || lpad(p::VARCHAR, 9, '0') AS sample_id, p::BIGINT AS retrieval_position, ((p - 63) // 32)::INT AS n_candidates FROM p""")
def planned_points(spark, sf_dir):
    """Retrieval points that come with the sequences."""
    s = t.sequences(spark, sf_dir).where("n_tokens >= 145")
    return planning.retrieval_plans(s, local=64, block=32, horizon=8, least=1, points=F.array(F.lit(95), F.lit(130))).select("sample_id", "retrieval_position", "n_candidates")


@query(f"""WITH {S}, b AS (SELECT sequence_id, unnest(range(n_tokens // 32)) AS i FROM s), p AS (SELECT sequence_id, i, i * 32 - CASE WHEN i % 4 = 3 THEN 2 ELSE 0 END AS a, i * 32 + 32 AS e FROM b)
  SELECT sequence_id, a::BIGINT AS start_position FROM (SELECT *, lag(e) OVER (PARTITION BY sequence_id ORDER BY a, e) AS before FROM p) WHERE a < before""")
def overlapping_blocks(spark, sf_dir):
    """Every fourth block begins two tokens early."""
    b = planning.mechanical_blocks(t.sequences(spark, sf_dir), 32)
    b = b.withColumn("start_position", F.col("start_position") - F.when(F.col("block_index") % 4 == 3, 2).otherwise(0))
    return planning.overlapping_blocks(b).select("sequence_id", "start_position")


# --- language-model measures ----------------------------------------------------------------------------------------------------


@query(f"""WITH {V}, l AS (SELECT a.id % 3 AS condition, a.id AS pos, unnest(range(64)) AS token, unnest(a.x) AS logit, unnest(b.x) AS full_logit, a.id % 64 AS target FROM v a JOIN v b ON b.id = a.id + 1),
  p AS (SELECT *, logit - ln(sum(exp(logit)) OVER w) AS lp, full_logit - ln(sum(exp(full_logit)) OVER w) AS lf, row_number() OVER (PARTITION BY condition, pos ORDER BY logit DESC, token) AS a, row_number() OVER (PARTITION BY condition, pos ORDER BY full_logit DESC, token) AS b FROM l WINDOW w AS (PARTITION BY condition, pos)),
  e AS (SELECT condition, pos, sum(-lp) FILTER (token = target) AS nll, sum(exp(lf) * (lf - lp)) AS kl, max((a = 1 AND b = 1)::INT) AS agree, max((a = 1 AND token = target)::INT) AS ok FROM p GROUP BY ALL)
  SELECT condition, round(avg(nll), 6) AS next_token_nll, round(greatest(0, avg(kl)), 6) AS kl_from_full_context, round(avg(agree), 6) AS full_argmax_agreement, round(avg(ok), 6) AS teacher_forced_token_accuracy FROM e GROUP BY condition""")
def prediction_metrics(spark, sf_dir):
    """A vector's numbers are a position's logits, the next vector's those with full context."""
    v = t.vectors(spark, sf_dir)
    both = v.select("id", "vector").join(v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("full")), "id")
    flat = both.select((F.col("id") % 3).alias("condition"), F.col("id").alias("pos"), (F.col("id") % 64).alias("target"), F.posexplode(F.arrays_zip("vector", "full")).alias("token", "x"))
    return rounded(lm_eval.prediction_metrics(flat.select("condition", "pos", "target", "token", F.col("x.vector").cast("double").alias("logit"), F.col("x.full").cast("double").alias("full_logit"))))


@query(f"""WITH {V}, l AS (SELECT label, id, unnest(x) AS x, unnest(list_transform(x, lambda a: a * 1.01 + 0.001)) AS y FROM v), k AS (SELECT label, id, max(abs(y - x)) AS m, sum(abs(y - x)) AS s, sum((y - x) ** 2) AS dd, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy, count(*) AS n FROM l GROUP BY ALL)
  SELECT label, round(max(m), 6) AS max_abs, round(sum(s) / sum(n), 6) AS mean_abs, round(sqrt(sum(dd) / sum(n)), 6) AS rms, round(sqrt(sum(dd) / sum(xx)), 6) AS relative_rmse, round(min(xy / sqrt(xx * yy)), 6) AS min_cosine, round(avg(xy / sqrt(xx * yy)), 6) AS mean_cosine FROM k GROUP BY label""")
def state_differences(spark, sf_dir):
    a = t.vectors(spark, sf_dir).select("label", F.col("id").alias("token"), F.posexplode("vector").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return rounded(lm_eval.state_differences(a, a.withColumn("x", F.col("x") * 1.01 + 0.001), ["label"]))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), o AS (SELECT doc_id, w, coalesce(sum(len(w) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM w),
  x AS (SELECT o, unnest(list_concat(w, ['<eos>'])) AS token, generate_subscripts(list_concat(w, ['<eos>']), 1) AS i FROM o WHERE o < 5000) SELECT o + i AS position, token FROM x WHERE o + i < 5000 UNION ALL SELECT 0, '<bos>'""")
def corpus_tokens(spark, sf_dir):
    """The first 5,000 tokens of the corpus laid end to end: the number is the feature."""
    c = _corpus(spark, sf_dir).select(F.col("offset").cast("long").alias("offset"), F.col("w").alias("tokens"))
    return prepare.corpus_tokens(c, 5000)


# --- placing --------------------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT conv_id AS key, turn AS rank, len(string_split(text, ' ')) AS n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY key) AS a, coalesce(sum(n) OVER (PARTITION BY key ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
  r AS (SELECT *, unnest(range(0, (299 // a + 1)::BIGINT)) AS round FROM s) SELECT key, round::BIGINT AS round, rank, least(n, 300 - round * a - before)::INT AS take FROM r WHERE 300 - round * a - before > 0""")
def filled_exactly(spark, sf_dir):
    """A conversation's messages in turn, as often as needed for 300 tokens."""
    p = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("rank"), F.split("text", " ").alias("token_ids"))
    return prepare.fill_exactly(p, F.lit(300))


@query("""WITH c AS (SELECT doc_id, 10 AS ins, 20 + doc_id % 5 AS tgt, 400 AS latest, doc_id % 4 AS b FROM documents), n AS (SELECT *, 16 AS first, (latest - tgt - 16) // 16 + 1 AS n FROM c), r AS (SELECT *, n * b // 4 AS low, n * (b + 1) // 4 AS high FROM n)
  SELECT doc_id, first + (low + ('0x' || substr(sha256('9:' || doc_id), 1, 12))::BIGINT % (high - low)) * 16 AS start FROM r""")
def stratified_starts(spark, sf_dir):
    i = F.col("doc_id")
    s = prepare.stratified_start(F.lit(10), 20 + i % 5, F.lit(400), 16, 4, i % 4, i, 9)
    return t.table(spark, sf_dir, "documents").select("doc_id", s.alias("start"))


@query("SELECT key, pos, coalesce(sum(n) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT conv_id AS key, turn AS pos, length(text) AS n FROM conversations)")
def region_layout(spark, sf_dir):
    """Where each message's span begins if a conversation's are laid end to end."""
    c = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.length("text").alias("n"))
    return trajectory.running_offset(c, "key", "pos", "n").select("key", "pos", F.col("offset").cast("long").alias("offset"))


# --- prompts --------------------------------------------------------------------------------------------------------------------

RECORDS = ITEMS + """, e AS (SELECT conv_id, trim(string_agg(role || ': ' || text, chr(10)) FILTER (turn = greatest(0, last - 1))) AS evidence FROM m GROUP BY conv_id),
  r AS (SELECT 'convomem_p_user_' || conv_id || '_0_' || substr(sha1(answer), 1, 10) AS fact, 'user ' || conv_id AS profile, evidence, category, lower(question) AS question_key, lower(answer) AS answer_key, source_file, 'For the user ' || conv_id || ' user, ' || lower(substr(question, 1, 1)) || substr(question, 2) AS asked FROM s JOIN e USING (conv_id)),
  f AS (SELECT *, 'User profile: ' || profile || chr(10) || 'Conversation evidence:' || chr(10) || evidence AS fp, 'User profile: ' || profile || chr(10) || chr(10) || 'Question: ' || asked AS qp FROM r ORDER BY sha256('13:' || fact), fact LIMIT 30)"""


@query(RECORDS + """ SELECT 'convomem_' || fact || '_' || c AS prompt_id, c AS condition_id, md5(CASE c WHEN 'fact_reference' THEN fp ELSE qp END) AS prompt_md5, md5(fp || chr(10) || chr(10) || 'Question: ' || asked) AS history_md5 FROM f, (VALUES ('fact_reference'), ('question_query')) t(c)""")
def fact_prompts(spark, sf_dir):
    """Of thirty facts: the number is the feature."""
    r = cut(files.evidence_records(spark, _tree(spark, sf_dir)))
    return prepare.fact_prompts(r, 30).select("prompt_id", "condition_id", F.md5("prompt").alias("prompt_md5"), F.md5("history_prompt").alias("history_md5"))


@query(RECORDS.replace("LIMIT 30", "LIMIT 30").replace("f AS (", "ff AS (") + """, k AS (SELECT *, row_number() OVER (ORDER BY fact) AS n FROM ff), g AS (SELECT * FROM k WHERE n <= 10) SELECT CASE c WHEN 'history_answer' THEN 'convomem_' || fact || '_history_answer' ELSE 'convomem_' || fact || '_' || c END AS prompt_id, c AS condition_id,
  md5(CASE c WHEN 'fact_reference' THEN fp WHEN 'question_query' THEN qp ELSE fp || chr(10) || chr(10) || 'Question: ' || asked END) AS prompt_md5 FROM g, (VALUES ('fact_reference'), ('question_query'), ('history_answer')) t(c)""")
def paired_prompts(spark, sf_dir):
    """Three rows for each of the first ten facts by id."""
    r = cut(files.evidence_records(spark, _tree(spark, sf_dir)))
    return prepare.paired_rows(prepare.fact_prompts(r, 30), 10).select("prompt_id", "condition_id", F.md5("prompt").alias("prompt_md5"))


# --- reports --------------------------------------------------------------------------------------------------------------------

FACTS = f"""WITH {U}, p AS (SELECT q.id, q.label = r.label AS same, q.label % 4 = r.label % 4 AS alike, list_dot_product(q.x, r.x) AS c FROM u q JOIN u r ON q.id % 2 = 0 AND r.id % 2 = 1)"""


@query(FACTS + """ SELECT round(coalesce(avg(c) FILTER (same), 0), 6) AS same_fact, round(coalesce(avg(c) FILTER (alike AND NOT same), 0), 6) AS same_question, round(coalesce(avg(c) FILTER (NOT alike), 0), 6) AS other_fact,
  round(coalesce(avg(c) FILTER (same), 0) - coalesce(avg(c) FILTER (NOT alike), 0), 6) AS fact_margin, round(coalesce(avg(c) FILTER (same), 0) - coalesce(avg(c) FILTER (alike AND NOT same), 0), 6) AS question_margin FROM p""")
def query_to_fact_means(spark, sf_dir):
    """Mean cosines of all queries (even ids) with all facts (odd ids): with their own fact, with others of the same question (labels equal modulo 4), and with the rest."""
    v = t.vectors(spark, sf_dir).withColumn("question", F.col("label") % 4)
    m = similarity.cross_means(v.where("id % 2 = 0"), v.where("id % 2 = 1"), "label", "question")
    at = lambda k, c: F.max(F.when(F.col("key") == k, F.col(c)))
    mean = lambda s, n: F.when(n > 0, s / n).otherwise(F.lit(0.0))
    one = m.agg(*[at(k, c).alias(f"{k}_{c}") for k in ("all", "label", "question") for c in ("pairs", "total")])
    d = lambda a, b, c: F.col(f"{a}_{c}") - F.col(f"{b}_{c}")
    r = one.select(mean(F.col("label_total"), F.col("label_pairs")).alias("same_fact"), mean(d("question", "label", "total"), d("question", "label", "pairs")).alias("same_question"), mean(d("all", "question", "total"), d("all", "question", "pairs")).alias("other_fact"))
    return rounded(r.withColumns({"fact_margin": F.col("same_fact") - F.col("other_fact"), "question_margin": F.col("same_fact") - F.col("same_question")}))


@query(f"""WITH {U}, s AS (SELECT q.id, q.label AS ql, q.label % 5 AS qe, r.label, r.label % 5 AS e, round(list_dot_product(q.x, r.x), 12) AS score, r.id AS rid FROM u q JOIN u r ON q.id <> r.id WHERE q.id % 100 = 0 AND q.id % 300 = 0),
  f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, rid DESC) = 1) SELECT count(*) AS conflict_queries, round(coalesce(avg((e = qe AND label <> ql)::INT), 0), 6) AS conflict_false_positive_rate FROM f""")
def conflict_report(spark, sf_dir):
    """A third of the queries is in conflict; labels equal modulo 5 are of one entity."""
    v = t.vectors(spark, sf_dir)
    found = similarity.neighbours(v, v.where("id % 100 = 0"), 1).withColumns({"query_conflict": F.col("query_id") % 300 == 0, "entity": F.col("label") % 5, "query_entity": F.col("query_label") % 5})
    return rounded(similarity.conflict_rate(found))


@query(f"""WITH {V}, d AS (SELECT id, label, unnest(x) AS a, generate_subscripts(x, 1) AS dim FROM v), z AS (SELECT dim, avg(a) AS m, greatest(stddev_samp(a), 1e-6) AS s FROM d GROUP BY dim), u AS (SELECT id, label, list((a - m) / s ORDER BY dim) AS x FROM d JOIN z USING (dim) GROUP BY id, label),
  p AS (SELECT q.label = r.label AS same, list_distance(q.x, r.x) AS c FROM u q JOIN u r ON q.id % 100 = 0 AND q.id <> r.id), n AS (SELECT count(*) - 1 AS refs FROM v)
  SELECT count(*) FILTER (same) AS same_pairs, count(*) FILTER (NOT same) AS other_pairs, round(coalesce(avg(c) FILTER (same), 0), 6) AS same_mean, round(avg(c) FILTER (NOT same), 6) AS other_mean, round(avg(c) FILTER (NOT same) - coalesce(avg(c) FILTER (same), 0), 6) AS margin, round(1 / max(refs), 6) AS chance_top1, round(10 / max(refs), 6) AS chance_top_k FROM p, n""")
def zscore_distance_report(spark, sf_dir):
    """Mean distances of the queries to rows of the same and of other labels, their margin, and what chance would give."""
    v = cut(similarity.zscored(t.vectors(spark, sf_dir)))
    m = similarity.distance_means(v, v.where("id % 100 = 0"), "euclid").crossJoin(F.broadcast(v.agg((F.count("*") - 1).alias("refs"))))  # one row each
    return rounded(m.select("same_pairs", "other_pairs", "same_mean", "other_mean", (F.col("other_mean") - F.col("same_mean")).alias("margin"), (1 / F.col("refs")).alias("chance_top1"), (F.least(F.lit(10), "refs") / F.col("refs")).alias("chance_top_k")))


@query(f"""WITH {U}, p AS (SELECT a.id % 4 AS method, a.label = b.label AS same, list_dot_product(a.x, b.x) AS c FROM u a JOIN u b ON a.id % 4 = b.id % 4 AND a.id < b.id), m AS (SELECT method, round(avg(c) FILTER (same), 6) AS recall, round(avg(c) FILTER (NOT same), 6) AS conflict, round(avg(c) FILTER (same) - avg(c) FILTER (NOT same), 6) AS margin FROM p GROUP BY method)
  SELECT method, CASE WHEN recall >= 0.8 AND conflict <= 0.1 THEN 'viable' WHEN margin > 0 AND recall >= 0.6 THEN 'viable only with canonical protocol' WHEN recall >= 0.4 THEN 'viable only for procedural/task memory' ELSE 'not viable for factual recall' END AS advice FROM m""")
def viability(spark, sf_dir):
    r = rounded(similarity.pair_means(t.vectors(spark, sf_dir).withColumn("method", F.col("id") % 4), ["method"]))
    return r.select("method", similarity.verdict(F.col("same_mean"), F.col("different_mean"), F.col("margin")).alias("advice"))


@query("""SELECT count(*) AS sequences, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, round(avg(n_chars), 6) AS mean_chars, sum(('0x' || substr(sha256(doc_id || ':' || n_chars), 1, 12))::BIGINT)::DECIMAL(38, 0)::VARCHAR AS digest FROM documents""")
def manifest_counts(spark, sf_dir):
    """Exact distinct counts, a mean, and a digest of all ids and lengths, as a manifest holds them: a sum of row hashes, so no order and no one row is needed."""
    d = t.table(spark, sf_dir, "documents")
    each = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string")), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return rounded(d.agg(F.count("*").alias("sequences"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.avg("n_chars").alias("mean_chars"), F.sum(each).cast("string").alias("digest")))


@query("""SELECT doc_id, '{"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}' AS metadata FROM documents""")
def metadata_columns(spark, sf_dir):
    """What isn't the id or the text goes along as JSON, and comes back from it."""
    d = t.table(spark, sf_dir, "documents")
    kept = prepare.with_metadata(d.select("doc_id", "text", "lang", "source", "n_chars"), ["doc_id", "text"])
    back = kept.select("doc_id", F.from_json("metadata", "lang string, source string, n_chars long").alias("m"))
    return back.select("doc_id", F.to_json("m").alias("metadata"))


@query("SELECT doc_id, lang AS run_lang, n_chars AS run_n_chars FROM documents")
def prefixed_columns(spark, sf_dir):
    return prepare.prefixed(t.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "run_", ["doc_id"])


# --- a tree of slots ------------------------------------------------------------------------------------------------------------

SUMS = "SELECT {by}, list(a ORDER BY dim) AS s FROM (SELECT {by}, dim, sum(a) AS a FROM d GROUP BY ALL) GROUP BY {by}"
TREE = f"""{REC}, d AS (SELECT slot, slot % 4 AS parent, unnest(vector) AS a, generate_subscripts(vector, 1) AS dim FROM w), ls AS ({SUMS.format(by="parent, slot")}), ps AS ({SUMS.format(by="parent")}),
  l AS (SELECT parent, slot, list_transform(s, lambda a: a / sqrt(list_dot_product(s, s))) AS c FROM ls), p AS (SELECT parent, list_transform(s, lambda a: a / sqrt(list_dot_product(s, s))) AS c FROM ps)"""


def _tree_of_slots(spark, sf_dir):
    r = t.records(spark, sf_dir).withColumn("parent", F.col("slot") % 4)
    return r, hierarchy.centres(r, "stream", "parent"), hierarchy.centres(r, "stream", "parent", "slot")


@query(TREE + """, q AS (SELECT record_id AS query_id, vector AS q FROM w WHERE record_id % 100 = 0), n AS (SELECT query_id, q, parent FROM q, p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, c), 12) DESC, parent) <= 2),
  m AS (SELECT query_id, q, slot FROM n JOIN l USING (parent) QUALIFY row_number() OVER (PARTITION BY query_id, parent ORDER BY round(list_dot_product(q, c), 12) DESC, slot) <= 3),
  f AS (SELECT query_id, record_id, round(list_dot_product(q, vector) / 8 + 0.5 / (1 + abs(query_id - write_time)), 12) AS score FROM m JOIN w USING (slot) WHERE exp(-0.0001 * abs(query_id - write_time)) >= 0.9)
  SELECT query_id, record_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id DESC) AS rank FROM f WHERE score >= 0.01 QUALIFY rank <= 4""")
def routed_reads(spark, sf_dir):
    """Every hundredth record asks: two parents, three leaves of each, four records of enough weight and score."""
    r, parents, leaves = _tree_of_slots(spark, sf_dir)
    q = r.where("record_id % 100 = 0").select("stream", F.col("record_id").alias("query_id"), F.col("vector").alias("q"), F.col("write_time").alias("now"))
    score = vector.native_score(F.col("q"), F.col("vector"), F.col("now"), F.col("write_time"), F.lit(0.0), F.lit(1), dims=64, time_bias=0.5)
    # a record's weight falls with its distance in time, so it is known once the query is
    seen = F.when(F.exp(-0.0001 * F.abs(F.col("now") - F.col("write_time"))) >= 0.9, score)
    return rounded(hierarchy.routed_reads(q, parents, leaves, r.select("stream", "slot", "record_id", "vector", "write_time"), seen, 2, 3, 4, 0.01))


@query(TREE.replace("WITH ", "WITH RECURSIVE ", 1) + """, pr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY round(list_dot_product(a.c, b.c), 12) DESC, a.slot, b.slot) AS n, a.slot AS a, b.slot AS b, round(list_dot_product(a.c, b.c), 12) AS score FROM l a JOIN l b ON a.parent = b.parent AND a.slot < b.slot WHERE (a.slot + b.slot) % 5 <> 0 AND round(list_dot_product(a.c, b.c), 12) >= 0),
  g AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS used, []::BIGINT[] AS taken UNION ALL SELECT pr.n, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE used || [a, b] END, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN taken ELSE taken || [pr.n] END FROM g JOIN pr ON pr.n = g.n + 1)
  SELECT a, b, round(score, 6) AS score FROM pr WHERE list_contains((SELECT taken FROM g ORDER BY n DESC LIMIT 1), n)""")
def best_merges(spark, sf_dir):
    """Pairs of slots of one parent, the most alike first, each slot in one pair at most; slots whose labels add up to a multiple of 5 mustn't meet."""
    _, _, leaves = _tree_of_slots(spark, sf_dir)
    leaves = cut(leaves)
    ids = leaves.select("parent", "slot")
    barred = ids.join(ids.withColumnRenamed("slot", "other"), "parent").where("slot < other AND (slot + other) % 5 = 0").select("slot", "other")
    return rounded(hierarchy.merge_pairs(leaves, barred, 0.0).select("a", "b", "score"))


@query()
def slot_splits(spark, sf_dir):
    """Which slots two means part well."""
    r = t.records(spark, sf_dir)
    return rounded(hierarchy.split_gains(r, hierarchy.two_means(r)).drop("stream"))


# --- stages, made-up samples ----------------------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS documents, 'words: ran, langs: ran; words: kept, langs: kept; words: ran, langs: ran' AS runs FROM documents WHERE n_chars > 0 GROUP BY lang")
def resumed_stages(spark, sf_dir):
    """Two stages, run, run again, and run with another configuration."""
    stages = [("words", lambda s, _: t.table(s, sf_dir, "documents").where("n_chars > 0").select("lang", "n_chars")), ("langs", lambda s, d: d.groupBy("lang").agg(F.count("*").alias("documents")))]
    root, runs = _folder(spark, "stages"), []
    for seed in (1, 1, 2):
        out, done = runner.run_stages(spark, root, stages, {"seed": seed, "_config_path": f"{seed}.json"})
        runs.append(", ".join(f"{name}: {how}" for name, how in done))
    return out.withColumn("runs", F.lit("; ".join(runs)))


DRAW = "('0x' || substr(sha256({}), 1, 12))::BIGINT / 281474976710656.0"


@query(f"""WITH n AS (SELECT i AS sample_id, 2 + floor({DRAW.format("'5:' || i || ':n'")} * 4)::INT AS n FROM range(200) r(i)), b AS (SELECT sample_id, unnest(range(n)) AS cand_index FROM n),
  m AS (SELECT *, {DRAW.format("'5:' || sample_id || ':' || cand_index || ':m'")} + 0.01 AS m, {DRAW.format("'5:' || sample_id || ':' || cand_index || ':1'")} * 2 - 1 AS x FROM b)
  SELECT sample_id, cand_index::INT AS cand_index, round(x, 6) AS second, round(m / sum(m) OVER (PARTITION BY sample_id), 6) AS mass FROM m""")
def synthetic_samples(spark, sf_dir):
    s = prepare.synthetic_samples(spark, 200, 3, 2, 5, seed=5)
    return rounded(s.select("sample_id", "cand_index", F.col("vector")[1].alias("second"), "mass"))


@query(READS + """, m AS (SELECT scenario, round(coalesce(avg(top1::INT) FILTER (NOT absent), 0), 6) AS t, round(coalesce(avg(hit::INT) FILTER (NOT absent), 0), 6) AS h FROM f GROUP BY scenario) SELECT scenario::VARCHAR AS method, h AS recall_at_k, t AS top1_accuracy FROM m ORDER BY h DESC, t DESC, method DESC LIMIT 1""")
def strongest_baseline(spark, sf_dir):
    m = read_metrics(spark, sf_dir).select(F.col("scenario").cast("string").alias("method"), "recall_at_k", "top1_accuracy")
    return temporal.effective_baseline(m, 0.01, 0.01)
