"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.llm import divergence, embedding_dups, exact_dedup, merkle, mixing_lm, packing, piece_codec, quality, repeats, sharding, simhash, token_counts, vector_codes
from mnemolith.llm.common import crc_mod, documents, embeddings
from mnemolith.session import remove, shared_dir


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.lm_scores(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so that a result never depends on earlier ones."""
    cache = f"{shared_dir(spark)}/token_counts_{uuid.uuid4().hex}"
    counts = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), cache)
    remove(spark, cache)  # its rows are in the result's checkpoint
    return counts


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.scores(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_edits(documents(spark, sf_dir))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(documents(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op12_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_vectors(embeddings(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(embeddings(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_pack, op2_piece_codec, op3_mixing_lm, op4_token_counts, op5_quality, op6_shards, op7_near_dedup, op8_exact_dedup, op9_merkle, op10_repeats, op11_divergence, op12_embedding_dups, op13_vector_codes)}


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round is one pair of CTEs: the nearest entry of each part, then the entries moved."""
    sound = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda a: a IS NULL OR isnan(a) OR isinf(a))) = 0"
    sql = f"""WITH x AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding::DOUBLE[], lambda a: floor(1024 * a)) AS x FROM embeddings WHERE {sound}),
      p AS MATERIALIZED (SELECT r, vec_id, k, x[k * len(x) // {parts} + 1 : (k + 1) * len(x) // {parts}] AS y FROM x, (SELECT unnest(range({parts})) AS k)),
      b0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id, y) - 1 AS e, y FROM p QUALIFY e < {entries})"""
    for n in range(rounds + 1):
        sql += f""",
      a{n} AS MATERIALIZED (SELECT r, k, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM
        (SELECT p.r, k, b.e, list_dot_product(p.y, p.y) - 2 * list_dot_product(p.y, b.y) + list_dot_product(b.y, b.y) AS d FROM p JOIN b{n} b USING (k)) GROUP BY r, k)"""
        if n < rounds:
            sql += f""",
      b{n + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(m.y, b.y) AS y FROM b{n} b LEFT JOIN (SELECT k, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS y FROM
        (SELECT k, e, i, sum(v)::HUGEINT AS s, count(*) AS n FROM (SELECT k, e, unnest(y)::BIGINT AS v, generate_subscripts(y, 1) AS i FROM a{n} JOIN p USING (r, k)) GROUP BY k, e, i) GROUP BY k, e) m USING (k, e))"""
    return sql + f""",
      f AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(v, ',' ORDER BY k, e, i)) FROM (SELECT k, e, unnest(y)::BIGINT::VARCHAR AS v, generate_subscripts(y, 1) AS i FROM b{rounds})) AS codebooks_sha256
      FROM f JOIN x USING (r)"""


ORACLE = {
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
    "op11_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT lang, source, r, unnest(w) AS term FROM d), g AS (SELECT DISTINCT lang, source FROM d),
        k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
        v AS (SELECT g.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k USING (lang) GROUP BY ALL),
        c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
        n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
        p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(n.total, 0) + 5 * v.v) AS p
            FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN n USING (lang, source)),
        l AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (m + 5) // (sum(m) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS m FROM c GROUP BY ALL) JOIN v USING (lang)),
        f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
          UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source JOIN v ON v.lang = a.lang WHERE v.v = 0
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f QUALIFY part = 'pair' OR rank <= 50""",
    "op12_embedding_dups": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x, embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda a: a IS NULL OR isnan(a) OR isinf(a))) = 0
            AND len(list_filter(embedding::DOUBLE[], lambda a: a <> 0)) > 0 AS able FROM embeddings),
        e AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM (SELECT * FROM v WHERE able) a JOIN (SELECT * FROM v WHERE able) b ON a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
        c AS (SELECT r, r AS to FROM v UNION SELECT c.r, e.b FROM c JOIN e ON c.to = e.a),
        m AS (SELECT c.r, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.to GROUP BY c.r)
        SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = v.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m USING (r)""",
    "op13_vector_codes": _codes_sql(),
}
