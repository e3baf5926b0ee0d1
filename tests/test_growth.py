"""Work that must not grow faster than its input."""

import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from mnemolith.functions import tokens, vector
from mnemolith.operators import attention, retrieval, synthesis


def test_long_vectors_take_a_pass(spark):
    # means and norms worked out once for a vector, not once for each of its numbers
    v = [math.sin(i) + 2 for i in range(600)]
    df = spark.createDataFrame([(i, [x + i for x in v]) for i in range(10)], "id long, v array<double>")
    began = time.time()
    got = {r.id: r.u for r in df.select("id", vector.unit(vector.centred(F.col("v"))).alias("u")).collect()}
    assert time.time() - began < 40
    mean = sum(v) / 600
    n = math.sqrt(sum((x - mean) ** 2 for x in v))
    assert all(abs(a - (b - mean) / n) < 1e-9 for u in got.values() for a, b in zip(u, v))
    none = spark.createDataFrame([(None,), ([0.0, 0.0],)], "v array<double>").select(vector.unit(vector.centred(F.col("v"))).alias("u")).collect()
    assert [r.u for r in none] == [None, [0.0, 0.0]]


def test_long_texts_take_a_pass(spark):
    rng = random.Random(1)
    text = "".join(rng.choice(["é", "ab", "🙂x", "c\x1cd"]) + rng.choice([" ", "\n\t", "  "]) for _ in range(150_000))
    began = time.time()
    got = spark.createDataFrame([(0, text), (1, None), (2, " \t")], "id long, text string").select("id", tokens.blank(F.col("text")).alias("p")).orderBy("id").collect()
    assert time.time() - began < 40
    words = list(re.finditer(r"[^ \t\n\x0b\f\r]+", text))
    assert [(p.id, p.start, p.end) for p in got[0].p] == [(int(hashlib.md5(m[0].encode()).hexdigest()[:7], 16), m.start(), m.end()) for m in words]
    assert got[1].p is None and got[2].p == []


def test_resamples_are_dealt_out(spark):
    # rows of few bytes, which come in one task, are drawn for in several
    rows = spark.range(300).coalesce(1).selectExpr("id % 2 AS g", "id", "id / 300 AS x")
    plan = retrieval.bootstrap(rows, ["g"], ["id"], "x", 50, 3)._jdf.queryExecution().toString()
    assert int(re.search(r"hashpartitioning\(__name[^,]*, (\d+)\), REPARTITION_BY_NUM", plan)[1]) >= 4


def test_readout_meets_in_parts(spark, monkeypatch):
    # parts of three: every query still sees all of its group, and no pair of a query and a key is a row
    monkeypatch.setattr(attention, "PART", 3)
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 3) for _ in range(4)]
    memory = [(i % 2, i, vec(), vec(), 1 + i % 3) for i in range(25)] + [(0, 25, None, vec(), 1), (None, 26, vec(), vec(), 1)]
    queries = [(100 + i, i % 2, vec()) for i in range(9)] + [(200, 0, None), (201, 7, vec())]
    m = spark.createDataFrame(memory, "label long, id long, key array<double>, value array<double>, n int")
    q = spark.createDataFrame(queries, "query_id long, label long, q array<double>")
    got = {(r.query_id, r.dim): r.value for r in attention.readout(q, m, "label", 4).collect()}
    want = {(200, d): None for d in range(4)}
    for i, label, x in queries[:9]:
        own = [(sum(a * b for a, b in zip(x, k)) / 2 + math.log(n), v) for g, _, k, v, n in memory if g == label and k]
        top = max(s for s, _ in own)
        total = sum(math.exp(s - top) for s, _ in own)
        want |= {(i, d): sum(math.exp(s - top) * v[d] for s, v in own) / total for d in range(4)}
    assert got.keys() == want.keys() and all(w is None and got[k] is None or abs(got[k] - w) < 1e-9 for k, w in want.items())


def test_texts_are_not_put_in_order(spark, monkeypatch):
    # ids, hashes and sizes are; a text is read where it is asked for, by either way, also if rows are equal
    written, real = [], synthesis.cut
    monkeypatch.setattr(synthesis, "cut", lambda df: written.append(df.columns) or real(df))
    texts = spark.createDataFrame([(i, f"Text {i % 5} of many", 1) for i in range(30)] + [(3, "Text 3 of many", 1), (40, None, 1)], "text_id long, text string, size int")
    targets = spark.createDataFrame([(100, "text 1", 8), (3, "TEXT 2", 40), (101, "", 4)], "target_id long, answer string, need int")
    ways = []
    for small in (1 << 20, 0):
        monkeypatch.setattr(synthesis, "SMALL", small)
        ways.append(sorted(map(tuple, synthesis.read_on(targets, texts, 2).collect())))
    assert ways[0] == ways[1] and not any("text" in c for c in written)
    taken = [(t, i) for t, i, _, _ in ways[0]]
    assert [t for t, _ in taken].count(100) == 8 and [t for t, _ in taken].count(101) == 0
    assert sorted(i for t, i in taken if t == 3) == [i for i in range(30) if i % 5 != 2 and i != 3]


def test_answers_that_most_texts_hold_are_listed(spark, monkeypatch):
    # targets of one answer that 7 of 400 texts are free of don't each read to where these are; some texts are targets too
    most, real = [], synthesis.cut

    def cut(df):
        out = real(df)
        if "from" in out.columns:
            most.append(out.agg(F.sum("from")).first()[0] or 0)
        return out

    monkeypatch.setattr(synthesis, "cut", cut)
    texts = [(i, "free" if i % 57 == 3 else f"Common {i}", 1 + i % 2) for i in range(400)]
    targets = [(i, "COMMON", 1 + i % 12) for i in range(3, 1000, 9)] + [(2000, "o", 40), (2001, "e", 2), (2002, "7", 9)]
    got = synthesis.read_on(spark.createDataFrame(targets, "target_id long, answer string, need int"), spark.createDataFrame(texts, "text_id long, text string, size int"), 6).collect()
    ranked = sorted(texts, key=lambda t: (hashlib.sha256(f"6:{t[0]}".encode()).hexdigest(), str(t[0])))
    for target, answer, need in targets:
        b = int(hashlib.sha256(f"6:start:{target}".encode()).hexdigest()[:12], 16) % 400
        wanted, total = [], 0
        for i, text, size in ranked[b:] + ranked[:b]:
            if i != target and answer.lower() not in text.lower() and total < need:
                wanted.append((i, size))
                total += size
        assert [(r.text_id, r["size"]) for r in sorted((r for r in got if r.target_id == target), key=lambda r: r["rank"])] == wanted
    assert max(most) <= 400 * 3


def test_answerable_against_all_pairs(spark):
    # by the shortest texts, by all texts, by one's own text only, and by none
    texts = [(str(i), f"every ab {i}" + " x" * i, 1) for i in range(40)] + [("40", "EVERY abc xyz without it", 1), ("41", "nothing", 0), ("42", None, 1)]
    targets = [("a", "every"), ("b", "AB 3"), ("40", "ab "), ("39", "ab "), ("c", "x"), ("0", "x"), (None, "z"), ("d", None), ("e", ""), ("5", "y ab 7 x")]
    got = synthesis.answerable(spark.createDataFrame(targets, "target_id string, answer string"), spark.createDataFrame(texts, "text_id string, text string, size int"))
    assert got.columns == ["target_id", "answer"]
    assert sorted(map(tuple, got.collect())) == sorted((t, a) for t, a in targets if t is not None and a is not None and any(i != t and x is not None and n > 0 and a.lower() not in x.lower() for i, x, n in texts))


def test_a_piece_moves_once(spark):
    # the tokens of what lies between meet their targets in one join, for both sides of the evidence
    rows = [(f"e{i:02d}", f"What is {i}?", f"a{i:02d}", f"User: evidence {i}", f"User: other words {i}") for i in range(12)]
    made = synthesis.long_sequences(spark.createDataFrame(rows, "example_id string, question string, answer string, evidence string, conversation string"), tokens.chars, 768, placement="stratified", block=16, local=64, most_answer=32)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"slice\(token_ids#\d+, 1, take", plan)) == 1


def test_words_of_many_texts_at_once(monkeypatch):
    # in runs of two words, with three ids kept: as one pass over each text
    monkeypatch.setattr(tokens, "RUN", 2)
    monkeypatch.setattr(tokens, "MOST_KNOWN", 3)
    texts = ["", "é  🙂x\ta\x1cb", " \n", "a b a c a d e", "\x0c\ra "]
    ids, starts, ends, sizes = tokens.words_of(texts)
    words = [m for t in texts for m in re.finditer(r"[^ \t\n\x0b\f\r]+", t)]
    assert ids.tolist() == [int(hashlib.md5(m[0].encode()).hexdigest()[:7], 16) for m in words]
    assert [(a, b) for a, b in zip(starts.tolist(), ends.tolist())] == [m.span() for m in words] and sizes.tolist() == [0, 3, 0, 7, 1]
    assert len(tokens.KNOWN) <= 3 and tokens.words_of([])[0].size == 0
