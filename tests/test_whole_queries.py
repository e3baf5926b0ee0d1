"""Queries that leave no row, condition, layer or block out; test_queries.py holds them against their SQL."""

from mnemolith.plans import queries


def test_every_record_has_a_weight(spark):
    sf = "/root/testdata/sf0.1"
    assert queries.QUERIES["record_weights"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count() > 1001


def test_every_condition_layer_and_block(spark):
    sf = "/root/testdata/sf0.001"
    prompts = queries.QUERIES["evidence_prompts"](spark, sf)
    assert {r[0]: r[1] for r in prompts.groupBy("condition_id").count().collect()} == dict.fromkeys(("evidence_only", "recent_context", "noisy_context"), prompts.select("entity").distinct().count())
    summary = queries.QUERIES["attention_event_summary"](spark, sf)
    assert {(r.layer, r.block_index) for r in summary.collect()} == {(layer, block) for layer in range(2) for block in range(5)}
