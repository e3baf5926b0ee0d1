"""Language-model scores: the base score against a direct count, and the model against the base on held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mnemolith.llm import mixing_lm


def words(text):
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def brute(rows):
    held = {id(r): zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1 for r in rows}
    counts = Counter(w for r in rows if not held[id(r)] for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    return [(held[id(r)], len(words(r.text)), sum(w in counts for w in words(r.text)), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(r.text))) for r in rows]


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score)


def compare(df, **how):
    rows = df.collect()
    got = sorted(mixing_lm.lm_scores(df, **how).collect(), key=key)
    wanted = sorted(zip(rows, brute(rows)), key=lambda x: (x[0].doc_id is None, x[0].doc_id or 0, x[1][1], x[1][4]))
    assert len(got) == len(wanted)
    for g, (r, (held, n_tokens, n_known, n, base)) in zip(got, wanted):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (r.doc_id, held, n_tokens, n_known, n)
        assert g.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(g.score) and g.score < 0
    return got


def test_documents(spark, docs):
    compare(docs, slots=18)


def test_learns_from_more_text(spark):
    """On held-out texts made of the training texts' words in the same order, the model beats single counts."""
    rng = random.Random(3)
    follow = {f"w{i}": [f"w{rng.randrange(400)}" for _ in range(3)] for i in range(400)}
    rows = []
    for k in range(400):
        w, text = "w0", []
        for _ in range(300):
            w = rng.choice(follow[w])
            text.append(w)
        rows.append((k, " ".join(text)))
    got = [g for g in mixing_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), slots=18).collect() if g.held_out]
    assert sum(g.score for g in got) > 0.5 * sum(g.base_score for g in got)


def test_rare_words_come_from_the_table(spark, docs):
    compare(docs, words=50, slots=16)


def test_odd_rows(spark, odd, empty):
    compare(odd, slots=16)
    assert mixing_lm.lm_scores(empty, slots=16).count() == 0


def test_an_end_rarer_than_the_words(spark):
    compare(spark.createDataFrame([(k, "a b c d " * 30 + f"e{k}") for k in range(10)], "doc_id long, text string"), words=4, slots=16)


def test_a_symbols_slots_are_side_by_side():
    """Four levels of a tree touch one run of 16 slots in each table, and no slot of it twice, so that reading them costs little."""
    coder = small_model(slots=18).coder
    contexts = [np.array([c], np.uint64) for c in (5 << 40, 6 << 40, 7 << 40)]
    for symbol in range(len(coder.code[1])):
        number, _, slot = coder.coded(np.array([symbol]), *contexts)
        for s in slot:
            for k in range(0, int(number[0]), 4):
                run = s[k : k + 4]
                assert len(set((run // 16).tolist())) == 1 and len(set(run.tolist())) == len(run)


def test_pairs_count_what_tokens_do():
    """Counted by different pairs of a symbol and its context, the slots get what they get token by token."""
    coder = small_model().coder
    t = mixing_lm.Tokens(pa.array(["the cat and the cat and the dog sat", "the cat sat.", "", "the hat (and) the cat"]))
    symbol, *contexts, _ = coder.look(t)
    for i, context in enumerate(contexts):
        single, paired = Counter(), Counter()
        _, at, (slot,) = coder.coded(symbol, context, first=i)
        single.update(zip(slot.tolist(), coder.code[3][at].tolist()))
        own, its, often = coder.pairs(symbol, context)
        assert len(own) < len(symbol)
        n, at, (slot,) = coder.coded(own, its, first=i)
        for s, bit, k in zip(slot.tolist(), coder.code[3][at].tolist(), np.repeat(often, n).tolist()):
            paired[s, bit] += k
        assert single == paired


def test_context_counts_against_plain_counts(spark):
    """The distributed tables, merged, against one pass over all tokens."""
    coder = small_model(slots=12).coder
    texts = ["the cat sat on the mat", None, "a dog and xylophone xylophone", "le chat et le chien", "the cat sat on the mat"] * 3
    once = np.arange(len(coder.code[1])) == coder.escape
    shared = spark.sparkContext.broadcast(([*coder.index], coder.code, coder.spelling, 12, once))
    df = spark.createDataFrame([(x or "",) for x in texts], "text string").repartition(3)
    wanted = np.zeros((mixing_lm.TABLES << 12, 2), np.int64)
    for x in texts:
        t = mixing_lm.Tokens(pa.array([x or ""]))
        symbol, *contexts, kind = coder.look(t)
        rare = np.flatnonzero(symbol == coder.escape)
        for c, (_, at, slot) in ((coder.code, coder.coded(symbol, *contexts)), *([(coder.spelling, coder.spelled([t.kinds[k] for k in t.kind[rare]], kind[rare]))] if len(rare) else [])):
            for s in slot:
                np.add.at(wanted, (s, c[3][at]), 1)
    assert (mixing_lm.context_counts(df, shared, 12) == (wanted[:, 1] << 16 | wanted[:, 0])).all()


def small_model(slots=14):
    """A coder over a few words, and tables filled from a few texts."""
    texts = ["the cat sat on the mat with the hat", "a cat and a dog sat on a log", "le chat et le chien", "the dog and the cat the mat"] * 5 + ["one new word", "xylophone of the year"]
    counts = Counter(w for x in texts for w in words(x))
    symbols = [*(w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:12]), mixing_lm.ESCAPE]
    code = mixing_lm.alphabetic(symbols, [*(counts[s] for s in symbols[:-1]), 9])
    spelling = mixing_lm.alphabetic(list(range(256)), [1 + 5 * (97 <= b < 123) for b in range(256)])
    coder = mixing_lm.Coder(symbols, code, spelling, slots)
    table = np.zeros((mixing_lm.TABLES << slots, 2), np.int64)
    t = mixing_lm.Tokens(pa.array(texts))
    symbol, *contexts, kind = coder.look(t)
    rare = np.flatnonzero(symbol == coder.escape)
    for c, (_, at, slot) in ((code, coder.coded(symbol, *contexts)), (spelling, coder.spelled([t.kinds[k] for k in t.kind[rare]], kind[rare]))):
        for s in slot:
            np.add.at(table, (s, c[3][at]), 1)
    return mixing_lm.Scorer(coder, (table[:, 1] << 16 | table[:, 0]).astype(np.uint32))


def plain_score(scorer, text):
    """One bit after the other, weights in plain lists."""
    coder, t = scorer.coder, mixing_lm.Tokens(pa.array([text]))
    symbol, *contexts, kind = coder.look(t)
    w = [row.tolist() for row in mixing_lm.FIRST.astype(float)]
    total, spelt = 0.0, []
    for begin in range(0, len(symbol), mixing_lm.BLOCK):
        block = range(begin, min(begin + mixing_lm.BLOCK, len(symbol)))
        for which in (0, 1):
            steps = []
            for i in block:
                if which and symbol[i] != coder.escape:
                    continue
                _, at, slot = coder.spelled([t.kinds[t.kind[i]]], kind[i : i + 1]) if which else coder.coded(symbol[i : i + 1], *(c[i : i + 1] for c in contexts))
                cost = 0.0
                for j, place in enumerate(at):
                    odds = float((coder.code, coder.spelling)[which][4][place])
                    p0 = odds / (1 + odds)
                    grown, seen = [], []
                    for k, drawn in enumerate(mixing_lm.DRAWN[which]):
                        c = int(scorer.table[slot[k][j]])
                        one, zero = c >> 16, c & 65535
                        before = p0 if k == 0 or which == 0 and k == 2 else grown[-1]
                        grown.append((one + drawn * before) / (one + zero + drawn))
                        seen.append(sum(one + zero >= x for x in (2, 16, 256)))
                    logit = [math.log(p / (1 - p)) for p in (p0, *grown)]
                    if which:
                        x, gate = [logit[1], *(b - a for a, b in zip(logit[1:], logit[2:]))], 16 + 4 * seen[1] + seen[3]
                    else:
                        x, gate = [logit[0], logit[1] - logit[0], logit[2] - logit[1], logit[3] - logit[0]], 4 * seen[0] + seen[1]
                    p = 1 / (1 + math.exp(-sum(w[k][gate] * x[k] for k in range(4))))
                    bit = int((coder.code, coder.spelling)[which][3][place])
                    cost -= math.log(p if bit else 1 - p)
                    steps.append((gate, [(bit - p) * v for v in x]))
                if which:
                    spelt.append(-cost)
                else:
                    total -= cost
            moved = {}
            for gate, g in steps:
                moved[gate] = [a + b for a, b in zip(moved.get(gate, [0.0] * 4), g)]
            for gate, g in moved.items():
                for k in range(4):
                    w[k][gate] += mixing_lm.RATE * max(-20, min(20, g[k]))
    return total, spelt


def test_scorer_against_plain_loops():
    scorer = small_model()
    texts = ["the cat sat on the log", "le chien et un oiseau", "", "word " * 200 + "the mat the hat " * 100]
    total, spelt = scorer.score(mixing_lm.Tokens(pa.array(texts)))
    spelt, at = spelt[spelt != 0], 0
    for k, text in enumerate(texts):
        one, each = plain_score(scorer, text)
        assert total[k] == pytest.approx(one, rel=1e-4)
        assert spelt[at : at + len(each)] == pytest.approx(each, rel=1e-4)
        at += len(each)
    assert at == len(spelt)


def test_long_texts_in_parts(monkeypatch):
    """A text that is worked on in parts, between others, scores as it does in one."""
    scorer = small_model()
    texts = ["the cat sat", "the mat and the log " * 300 + "odd", "a dog sat on the hat", "le chien " * 200]
    whole = scorer.score(mixing_lm.Tokens(pa.array(texts)))
    monkeypatch.setattr(mixing_lm, "AT_ONCE", 4 * mixing_lm.BLOCK)
    parts = scorer.score(mixing_lm.Tokens(pa.array(texts)))
    assert parts[0] == pytest.approx(whole[0], rel=1e-4) and parts[1] == pytest.approx(whole[1], rel=1e-3)


def test_probabilities_sum_to_one():
    """Over all symbols that can follow, and over all bytes that can follow in a word."""
    scorer = small_model()
    coder, n = scorer.coder, len(scorer.coder.code[1])

    def bits(kind, at, slot):
        x, gate = scorer.inputs(kind, at, slot)
        p = 1 / (1 + np.exp(-(mixing_lm.FIRST[:, gate] * x).sum(axis=0)))
        return np.where((coder.code, coder.spelling)[kind][3][at] == 1, p, 1 - p)

    for text in ("the cat", "le chat et", "nothing known"):
        t = mixing_lm.Tokens(pa.array([text]))
        _, *contexts, _ = coder.look(t)
        for i in range(len(t.kind)):
            number, at, slot = coder.coded(np.arange(n), *(np.repeat(c[i], n) for c in contexts))
            each = np.multiply.reduceat(bits(0, at, slot), np.cumsum(number) - number)
            assert each.sum() == pytest.approx(1, abs=1e-4)
    letters = [bytes([b]) for b in range(256)]
    for start in (b"", b"th", b"xylo"):
        number, at, slot = coder.spelled([start + b for b in letters], np.zeros(256, np.uint64))
        p = bits(1, at, slot)
        first, per = np.cumsum(number) - number, coder.spelling[1]
        skip = int(sum(per[b] for b in start))
        total = sum(float(np.prod(p[f + skip : f + skip + per[b]])) for b, f in enumerate(first))
        assert total == pytest.approx(1, abs=1e-4)


def test_beats_single_counts_held_out(spark):
    """On a table large enough for most held-out words to be known."""
    got = [g for g in mixing_lm.lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect() if g.held_out]
    assert sum(g.score for g in got) > sum(g.base_score for g in got)
