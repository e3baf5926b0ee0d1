import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from mnemolith.llm.piece_codec import SHORT, UNIT, PieceCodec, decode_documents, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def unigram_library(tmp_path):
    """The library's own Viterbi over the same pieces: the model file with its type set to unigram."""
    raw = open(PATH, "rb").read()
    for k in range(len(raw)):
        if raw[k : k + 2] == b"\x18\x02":  # trainer_spec.model_type = BPE
            changed = raw[:k] + b"\x18\x01" + raw[k + 2 :]
            try:
                model = sentencepiece.SentencePieceProcessor(model_proto=changed)
                bpe = sentencepiece.SentencePieceProcessor(model_file=PATH)
                if model.encode("tokenization of strange words") != bpe.encode("tokenization of strange words"):
                    return model
            except RuntimeError:
                continue
    return None


def best_score(codec, marked):
    n = len(marked)
    best = [0.0] + [float("-inf")] * n
    for end in range(1, n + 1):
        for start in range(max(0, end - codec.longest), end):
            piece = codec.score.get(marked[start:end])
            if piece:
                best[end] = max(best[end], best[start] + piece[0])
        if marked[end - 1] not in codec.score:
            best[end] = max(best[end], best[end - 1] + codec.floor)
    return best[n]


def score_of(codec, ids):
    total, k = 0.0, 0
    while k < len(ids):
        if ids[k] in codec.raw:  # the bytes of one character
            first = codec.raw[ids[k]][0]
            k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            total += codec.floor
        else:
            total += codec.score[codec.pieces[ids[k]]][0]
            k += 1
    return total


def test_best_path_and_commits():
    codec, rng = PieceCodec(PATH), random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["the", "tion", "er", " ", "  ", "é", "🙂", "x", "\n", "ß", "qu"]) for _ in range(rng.randint(1, 60)))
        marked = "▁" + text.replace(" ", "▁")
        ids = codec.encode(text)
        assert score_of(codec, ids) == best_score(codec, marked)
        streamed = list(codec.stream(marked))
        assert [i for run in streamed for i in run] == ids or score_of(codec, [i for run in streamed for i in run]) == score_of(codec, ids)
        assert codec.decode(ids) == text
    long = list(codec.stream("ab" * 20_000))
    assert len(long) > 1000 and sum(map(len, long)) >= 5000  # committed as it goes


def test_agrees_with_the_library(tmp_path):
    """Where no character falls back to bytes, whose penalty swamps the library's 32-bit sums."""
    library, codec = unigram_library(tmp_path), PieceCodec(PATH)
    assert library is not None
    for t in ("a few plain words", "  spaces   inside ", "naïve façade", "unbelievable", "x\ny"):
        assert codec.encode(t) == library.encode(t)


def test_whole_table_has_the_best_score(docs):
    """Every whole text's ids are worth as much as a full table in 64 bits says is possible, whatever was remembered."""
    codec = PieceCodec(PATH)
    for r in docs.select("text").collect():
        text = r.text or ""
        if text:
            ids = codec.encode(text)
            # units are independent, so the full table is kept for each
            marked = "▁" + text.replace(" ", "▁")
            wanted = sum(best_score(codec, u) for u in UNIT.findall(marked))
            assert score_of(codec, ids) == wanted
            assert codec.decode(ids) == text.replace("▁", " ")


def test_long_units_pass_the_window():
    codec, rng = PieceCodec(PATH), random.Random(4)
    for n in (17, 100, 1000):
        word = "".join(rng.choice("abcdeéß🙂") for _ in range(n))
        ids = codec.encode(word)
        assert score_of(codec, ids) == best_score(codec, "▁" + word)


def test_documents(docs, odd, empty):
    codec = PieceCodec(PATH)
    for df in (docs.limit(60), odd):
        rows = df.select("doc_id", "text").collect()
        got = sorted((tuple(r) for r in encode_documents(df, PATH).collect()), key=str)
        want = []
        for i, t in rows:
            ids = codec.encode(t or "")
            want.append((i, len(t or ""), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
        assert got == sorted(want, key=str)
    back = decode_documents(encode_documents(odd, PATH, keep_ids=True), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r.doc_id, (r.text or "").replace("▁", " ")) for r in odd.collect()), key=str)
    assert encode_documents(empty, PATH).count() == 0


def test_short_units_are_searched_alike():
    """The search of a unit at once, by the tree of pieces, commits to what the streaming one does; long units aren't remembered."""
    codec = PieceCodec(PATH)
    rng = random.Random(3)
    units = ["▁" + "".join(rng.choice("aeinrst.,é0▁ﬁ🙂") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    for u in units:
        assert codec.short(u) == [i for run in codec.stream(u) for i in run]
    long = "ab" * 40
    assert codec.decode(codec.encode(f"x {long} x")) == f"x {long} x"
    assert not any(len(u) > SHORT for u in codec.known)
