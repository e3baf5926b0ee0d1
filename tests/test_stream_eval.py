"""Sequential evaluation against plain code; a planted leak; what assembly refuses."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mnemolith.operators import stream_eval
from mnemolith.streaming import banks


def test_windows_read_earlier_windows_only(spark):
    rng = random.Random(2)
    rows = [(s, w, i, rng.choice("xyz"), rng.gauss(0, 1)) for s in (0, 1) for w in range(9) for i in range(rng.randrange(1, 7))]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "stream int, win int, seq int, key string, value double").repartition(3)
    got = stream_eval.recalled(df, "key", "value").collect()
    assert len(got) == len(rows)
    wanted, losses = {}, {}
    for s, w, i, k, v in rows:
        before = [(b, j, x) for t, b, j, q, x in rows if t == s and q == k and b < w]
        wanted[s, w, i] = max(before)[2] if before else None
        for m, loss in (("base", abs(v)), ("memory", abs(v - (wanted[s, w, i] or 0.0)))):
            losses.setdefault((m, s, w), []).append(loss)
    assert {(r.stream, r.win, r.seq): r.recalled for r in got} == wanted
    made = stream_eval.window_losses(stream_eval.recalled(df, "key", "value"), {"base": F.abs("value"), "memory": F.abs(F.col("value") - F.coalesce("recalled", F.lit(0.0)))})
    for r in stream_eval.perplexities(made).collect():
        own = losses[r.method, r.stream, r.win]
        past = [x for (m, s, w), ls in losses.items() if (m, s) == (r.method, r.stream) and w <= r.win for x in ls]
        assert r.tokens == len(own)
        assert math.isclose(r.perplexity, math.exp(sum(own) / len(own))) and math.isclose(r.so_far, math.exp(sum(past) / len(past)))
    c = {r.method: r for r in stream_eval.comparison(made, "base").collect()}
    every = {m: [x for (n, _, _), ls in losses.items() if n == m for x in ls] for m in ("base", "memory")}
    assert math.isclose(c["memory"].gain, (sum(every["base"]) - sum(every["memory"])) / len(rows), abs_tol=1e-12) and c["base"].windows_won == 0
    large = spark.createDataFrame([("m", 0, 0, 1, 1e6)], "method string, stream int, win int, tokens long, nll double")
    assert stream_eval.perplexities(large).first().perplexity == math.exp(700)


def test_a_planted_leak_is_found(spark):
    events = [("s", 0, "g", w, i, "write" if i else "read", [math.cos(w + i), math.sin(w + i)], [1.0], f"{w}-{i}") for w in range(5) for i in range(4)]
    schema = "stream string, layer int, grp string, win long, seq long, op string, vector array<double>, value array<double>, source string"
    df = spark.createDataFrame(events, schema)
    reads = banks.run_batch(df, banks.BankPolicy(), top_k=3).where("op = 'read'")
    writes = df.where("op = 'write'").select("stream", "win", "source")
    assert reads.where(F.size("results") > 0).count() == 4
    assert stream_eval.leaks(reads, writes).count() == 0
    planted = reads.select("stream", "win", "seq", F.when(F.col("win") == 3, F.array(F.lit("3-1"), F.lit("4-2"), F.lit("0-1"))).otherwise(F.col("results")).alias("results"))
    assert sorted((r.win, r.source, r.written) for r in stream_eval.leaks(planted, writes).collect()) == [(3, "3-1", 3), (3, "4-2", 4)]


def test_assembly(spark):
    plans = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "b")], "sample_id long, cand_index int, block_id string")
    queries = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "sample_id long, query array<double>")
    blocks = spark.createDataFrame([("a", [3.0]), ("b", [4.0]), ("c", [5.0])], "block_id string, summary array<double>")
    targets = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75), (2, 0, 1.0)], "sample_id long, cand_index int, mass double")
    got = {r.sample_id: r for r in stream_eval.assembled(plans, queries, blocks, targets).collect()}
    assert (got[1].block_ids, got[1].summaries, got[1].masses) == (["a", "b"], [[3.0], [4.0]], [0.25, 0.75]) and got[2].query == [2.0]
    for broken, said in (((plans, queries.where("sample_id = 1"), blocks, targets), "no query for 2"), ((plans, queries, blocks.where("block_id = 'a'"), targets), "no summary for"), ((plans, queries, blocks, targets.where("mass <> 0.75")), "no target for 1:1"), ((plans.where("sample_id = 1"), queries, blocks, targets), "no candidate for 2:0")):
        with pytest.raises(Exception, match=said):
            stream_eval.assembled(*broken).collect()
