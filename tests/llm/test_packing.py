import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from mnemolith.llm.packing import pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(counts, capacity):
    runs = plan(dict(counts), capacity)
    placed, spans = {s: 0 for s in counts}, {}
    for s, rank, n, first, offset in sorted(runs):
        assert rank == placed[s]
        placed[s] += n
        for k in range(first, first + n):
            spans.setdefault(k, []).append((offset, s))
    assert placed == dict(counts)
    for parts in spans.values():
        at = 0
        for offset, s in sorted(parts):
            assert offset == at
            at += s
        assert at <= capacity
    return len(spans)


def test_plan_is_gapless_and_tight():
    rng = random.Random(3)
    for top, n in ((100, 500), (30, 2000), (100, 7), (100, 0)):
        counts = {}
        for _ in range(n):
            s = rng.randint(1, top)
            counts[s] = counts.get(s, 0) + 1
        bins, total = check_plan(counts, 100), sum(s * k for s, k in counts.items())
        assert bins <= max(total / 100 * 1.06 + 3, sum(k for s, k in counts.items() if s > 50) + 3)
    assert check_plan({51: 1000, 49: 1000}, 100) == 1000
    assert check_plan({100: 5000}, 100) == 5000


def test_pack(docs, odd, empty):
    library = Tokenizer.from_file(PATH)
    for df, capacity in ((docs, 4096), (odd, 4096), (odd, 16)):
        want = []
        for r in df.collect():
            ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
            want += [(r.doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
        got = pack(df, PATH, capacity).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
        total = sum(r.length for r in got)
        assert len(sequences) <= total / capacity * 1.05 + 2
    assert pack(empty, PATH).count() == 0
