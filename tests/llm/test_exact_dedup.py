import hashlib
import re

from mnemolith.llm.exact_dedup import drop_copies, exact_groups


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_groups(docs, odd):
    for df in (docs, odd):
        got = exact_groups(df).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute([(r.doc_id, r.text) for r in df.collect()])
        by_text = {}
        for r in got:
            by_text[r.text_sha256] = by_text.get(r.text_sha256, 0) + r.kept
        assert set(by_text.values()) == {1}
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_full_filter_changes_nothing(docs):
    small = exact_groups(docs, max_bits=1 << 16, bits_per_row=1, k=1)
    assert sorted(small.collect()) == sorted(exact_groups(docs).collect())


def test_drop_copies(odd, empty):
    kept = drop_copies(odd).collect()
    assert {norm(r.text) for r in kept} == {norm(r.text) for r in odd.collect()}
    assert len(kept) == len({norm(r.text) for r in kept})
    assert kept[0].asDict().keys() == odd.first().asDict().keys()
    assert drop_copies(empty).count() == exact_groups(empty).count() == 0
