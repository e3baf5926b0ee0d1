import hashlib
import random
import re

import pyarrow as pa

from mnemolith.llm import repeats
from mnemolith.llm.repeats import repeat_report, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """The same spans from a table of all windows."""
    rows = [(i, WORD.findall(t or "")) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, w in rows:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key not in first or order(i) < order(first[key]):
                first[key] = i
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if order(first[tuple(w[k : k + window])]) < order(i):
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def planted(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for i in range(80):
        w = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            a, n = rng.randint(0, 50), rng.randint(10, 60)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + n]
        if i % 10 == 0:
            w += w[:30]  # repeats within a document stay
        rows.append((rng.choice([i, i, i, None]) if i > 70 else i // 2 if i > 60 else i, " ".join(w)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[6][1]), (7, rows[9][1]), (7, rows[9][1])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_report(spark, docs, odd, empty):
    for df in (docs, odd, planted(spark)):
        got = sorted((tuple(r) for r in repeat_report(df).collect()), key=str)
        assert got == brute([(r.doc_id, r.text) for r in df.collect()], 13)
    assert repeat_report(empty).count() == without_repeats(empty, 13).count() == 0


def test_texts(spark, odd):
    for df in (planted(spark), odd):
        clean = without_repeats(df, 13)
        assert clean.columns == df.columns and clean.count() == df.count()
        got = sorted(((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in clean.collect()), key=str)
        assert got == sorted(((i, s) for i, _, _, s in brute([(r.doc_id, r.text) for r in df.collect()], 13)), key=str)


def test_word_hashes_tell_words_apart_wherever_they_stand(monkeypatch):
    """Small chunks, slices of an array, texts without blanks between them, giant words: a word has one hash, and no two share one."""
    rng = random.Random(3)
    words = ["a", "b", "ab", "ba", "aa", "é", "\x1c", "\x00", "\x00\x00", "x" * 5000, "x" * 4999 + "y", "y" + "x" * 4999, "ﬁ🙂", *(f"w{k}" for k in range(200))]
    texts = ["", " ", "a", "ab", "\t\n", *(rng.choice(["", " "]) + "".join(w + rng.choice([" ", "\n", "  ", "\x0b"]) for w in rng.choices(words, k=rng.randrange(30))).rstrip(" ") for _ in range(200)), " "]
    plain = [WORD.findall(t) for t in texts]
    for chunk in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        for kind in (pa.string(), pa.large_string()):
            a = pa.array(["skipped text", *texts], kind)[1:]
            hashes, counts = repeats.word_hashes(a)
            assert counts.tolist() == [len(p) for p in plain]
            seen = {}
            for w, h in zip((w for p in plain for w in p), hashes.tolist(), strict=True):
                assert seen.setdefault(w, h) == h
            assert len(set(seen.values())) == len(seen)
    none, counts = repeats.word_hashes(pa.array([], pa.string()))
    assert len(none) == len(counts) == 0
