"""Exact lengths, placement, and what lies between, against plain code; tokenizers and the loader."""

import hashlib
import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mnemolith.functions import tokens
from mnemolith.operators import synthesis

EXAMPLES = "example_id string, question string, answer string, evidence string, conversation string"


def order(key, seed):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), key


def begin(key, n, seed):
    return int(hashlib.sha256(f"{seed}:start:{key}".encode()).hexdigest()[:12], 16) % n


def between(target, answer, need, pool, seed):
    """Token ids of other conversations, in turn from the target's own place."""
    ranked = sorted(pool, key=lambda i: order(i, seed))
    b = begin(target, len(ranked), seed)
    fit = [i for i in ranked[b:] + ranked[:b] if i != target and answer.lower() not in pool[i].lower()]
    out, k = [], 0
    while len(out) < need:
        out += [ord(c) + 10 for c in pool[fit[k % len(fit)]]]
        k += 1
    return out[:need]


def made(n):
    return [(f"example-{i:02d}", f"What is fact {i}?", f"answer-{i:02d}", f"User: evidence-{i}", f"User: unrelated-conversation-{i}" + (" answer-03" if i % 4 == 1 else "")) for i in range(n)]


def test_fixed_start(spark):
    rows = made(6)
    got = synthesis.long_sequences(spark.createDataFrame(rows, EXAMPLES), tokens.chars, 512, 4, most_answer=32).collect()
    assert len(got) == 4
    pool = {r[0]: synthesis.BETWEEN[0] + r[4] + synthesis.BETWEEN[1] for r in rows}
    by_id = {r[0]: r for r in rows}
    for r in got:
        _, question, answer, evidence, _ = by_id[r.example_id]
        head, tail = synthesis.TASK + synthesis.EARLIER + evidence + "\n\n", f"Question: {question}\n"
        need = 512 - len(answer) - 1 - len(head) - len(tail)
        text = [ord(c) + 10 for c in head] + between(r.example_id, answer, need, pool, 13) + [ord(c) + 10 for c in tail + answer] + [1]
        assert r.token_ids == text and len(text) == 512
        assert r.token_ids[r.evidence_start : r.evidence_end] == [ord(c) + 10 for c in evidence]
        assert r.token_ids[r.question_start : r.question_end] == [ord(c) + 10 for c in f"Question: {question}"]
        assert r.token_ids[r.answer_start : r.answer_end] == [ord(c) + 10 for c in answer]
        assert r.distance == r.answer_start - r.evidence_end > 256 and r.distractor_tokens == need
        assert r.retrieval_position == r.answer_start - 2 and r.future_horizon == len(answer)


def test_stratified(spark):
    rows = made(12)
    got = synthesis.long_sequences(spark.createDataFrame(rows, EXAMPLES), tokens.chars, 768, 8, "stratified", bins=4, block=16, local=64, most_answer=32).collect()
    got.sort(key=lambda r: r.sequence_index)
    assert [r.bin for r in got] == [0, 1, 2, 3] * 2
    assert len({r.chunk_start for r in got}) >= 4
    means = [sum(r.chunk_start for r in got if r.bin == b) / 2 for b in range(4)]
    assert means == sorted(means)
    by_id = {r[0]: r for r in rows}
    pool = {r[0]: synthesis.MEMORY[0] + r[4] + synthesis.MEMORY[1] for r in rows}
    for r in got:
        _, question, answer, evidence, _ = by_id[r.example_id]
        assert len(r.token_ids) == 768 and r.chunk_start % 16 == 0
        assert -(-r.chunk_end // 16) * 16 <= r.answer_start - 1 - 64
        chunk = [ord(c) + 10 for c in synthesis.MEMORY[0] + evidence + synthesis.MEMORY[1]]
        before, after = (between(r.example_id, answer, n, pool, 13 + k) for k, n in ((1, r.chunk_start - r.memory_start), (2, r.question_start - r.chunk_end)))
        text = [ord(c) + 10 for c in synthesis.TASK] + before + chunk + after + [ord(c) + 10 for c in f"Question: {question}\n" + answer] + [1]
        assert r.token_ids == text
        assert r.token_ids[r.evidence_start : r.evidence_end] == [ord(c) + 10 for c in evidence]
        assert "Relevant earlier conversation" not in "".join(chr(t - 10) for t in r.token_ids[:-1])


def test_what_does_not_fit(spark):
    rows = [("a", "q", "", "e", "c"), ("b", "q", "x" * 40, "e", "c"), ("c", "q", "conv", "e", "conv"), ("d", "q", "z", "e" * 600, "conv"), ("e", "q", "ok", "e", "conv")]
    got = synthesis.long_sequences(spark.createDataFrame(rows, EXAMPLES), tokens.chars, 512, most_answer=32).collect()
    assert sorted(r.example_id for r in got) == ["c", "e"]
    assert synthesis.long_sequences(spark.createDataFrame(rows[2:3], EXAMPLES), tokens.chars, 512).count() == 0
    assert synthesis.long_sequences(spark.createDataFrame([], EXAMPLES), tokens.chars, 512).count() == 0


@pytest.mark.parametrize("need", [1, 7, 60, 10_000])
def test_read_on(spark, need):
    texts = [(i, f"text {i} " + "ab"[i % 2] * (i % 5), 1 + i % 3) for i in range(40)] + [(None, "x", 1), (99, None, 1)]
    targets = [(i, "bb" if i % 3 else f"text {i}", need) for i in range(0, 60, 7)] + [(None, "a", need), (98, None, need)]
    got = synthesis.read_on(spark.createDataFrame(targets, "target_id long, answer string, need int"), spark.createDataFrame(texts, "text_id long, text string, size int"), 5).collect()
    ranked = sorted((t for t in texts if t[0] is not None and t[1] is not None), key=lambda t: (hashlib.sha256(f"5:{t[0]}".encode()).hexdigest(), t[0]))
    for target, answer, _ in targets:
        wanted, total = [], 0
        if target is not None and answer is not None:
            b = begin(target, len(ranked), 5)
            for i, text, size in ranked[b:] + ranked[:b]:
                if i != target and answer not in text and total < need:
                    wanted.append(i)
                    total += size
        assert [r.text_id for r in sorted((r for r in got if r.target_id == target), key=lambda r: r["rank"])] == wanted


def test_tokenizers(spark):
    texts = ["  two words\n", "", "naïve ﬁ 🙂 x", "a\tb  c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", tokens.tokenizer("blank")(F.col("text")).alias("p"), tokens.tokenizer("chars")(F.col("text")).alias("c")).collect():
        assert [r.text[p.start : p.end] for p in r.p] == r.text.split()
        assert [p.id for p in r.p] == [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in r.text.split()]
        assert [(p.id, p.start, p.end) for p in r.c] == [(ord(c) + 10, k, k + 1) for k, c in enumerate(r.text)]
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    for r in df.select("text", tokens.tokenizer(f"file:{path}")(F.col("text")).alias("p")).collect():
        e = model.encode(r.text, add_special_tokens=False)
        assert [(p.id, p.start, p.end) for p in r.p] == [(i, *o) for i, o in zip(e.ids, e.offsets)]
    with pytest.raises(KeyError, match="no tokenizer"):
        tokens.tokenizer("none")
    tokens.register("first", lambda c: F.slice(tokens.blank(c), 1, 1))
    assert df.select(F.size(tokens.tokenizer("first")(F.col("text"))).alias("n")).agg(F.max("n")).first()[0] == 1


def test_loader(spark):
    rows = [("a", [1, 2, 3, 4], None, "text", "kept"), ("b", None, [("user", "Hi you"), ("assistant", "Yes")], "text", None), ("c", None, None, "just a text", "x")]
    schema = "sequence_id string, token_ids array<int>, messages array<struct<role:string,content:string>>, text string, note string"
    df = spark.createDataFrame(rows, schema)
    got = {r.sequence_id: r for r in tokens.load_sequences(df, tokens.blank, 3).collect()}
    word = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:7], 16)
    assert got["a"].token_ids == [1, 2, 3] and got["b"].token_ids == [word("user:"), word("Hi"), word("you")] and got["c"].token_ids == [word(w) for w in ("just", "a", "text")]
    assert [json.loads(got[i].metadata)["tokenization_source"] for i in "abc"] == ["provided_token_ids", "chat_template", "text"]
    assert json.loads(got["a"].metadata)["note"] == "kept"
    assert tokens.load_sequences(df.select("sequence_id", F.lit("t").alias("text")), tokens.chars).count() == 3
    with pytest.raises(ValueError, match="comes 2 times"):
        tokens.load_sequences(df.unionByName(df.where("sequence_id = 'a'")), tokens.blank)
    with pytest.raises(ValueError, match="no sequences"):
        tokens.load_sequences(df.where("false"), tokens.blank)
    with pytest.raises(Exception, match="no token_ids, messages or text in row z"):
        tokens.load_sequences(spark.createDataFrame([("z", None, None, None, None)], schema), tokens.blank)
