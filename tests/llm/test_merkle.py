import hashlib

import xxhash

from mnemolith.llm.merkle import differing, fingerprint, fingerprints, likeness, with_edits


def test_tree():
    text = "One. Two.\nThree. Four\n\nFive\nSix"
    assert fingerprint(text) == fingerprint(text)
    assert len({fingerprint(t) for t in (text, text + "\n", text + " ", text.replace("Two", "Too"), "", " ", "\n", "a. b", "a.b")}) == 9
    assert differing(fingerprint(text), fingerprint(text.replace("Six", "Seven"))) == [(1, 1)]
    assert differing(fingerprint(text), fingerprint(text.replace("One", "Won"))) == [(0, 0)]
    assert differing(fingerprint(text), fingerprint(text)) == []
    assert 0 < likeness(fingerprint(text), fingerprint(text.replace("Six", "Seven"))) < 1
    assert likeness(fingerprint(""), fingerprint("")) == 1
    assert likeness(fingerprint(""), fingerprint("x")) == 0
    assert likeness(fingerprint("abc"), fingerprint("xyz")) == 0


def test_edits(docs, odd, empty):
    for df in (docs.repartition(7), odd, docs.limit(1)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
        ids = list(dict.fromkeys(i for i, _ in rows))
        first = {i: min(t for j, t in rows if j == i) for i in ids}
        want = []
        for i, t in rows:
            other = first[ids[(ids.index(i) + 1) % len(ids)]]
            half = len(t) // 2
            edited = t[: len(t) - half] + other[:half]
            a, b = fingerprint(t), fingerprint(edited)
            want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, fingerprint(other))))
        got = with_edits(df).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert with_edits(empty).count() == fingerprints(empty).count() == 0


def tree(text):
    """Sections of paragraphs of leaves, as lists."""
    lines, sections, open_ = text.split("\n") if text else [], [], []
    for line in lines:
        leaves = [s.encode()[k : k + 256] for s in line.split(". ") for k in range(0, max(1, len(s.encode())), 256)] if line else []
        open_.append(leaves)
        if not line:
            sections.append(open_)
            open_ = []
    return sections + [open_] if open_ else sections


def digest(node):
    """A node's digest is that of its children's, down to the leaves' bytes."""
    return xxhash.xxh64(node if isinstance(node, bytes) else b"".join(map(digest, node))).digest()


def test_fingerprints_and_likeness_against_a_tree_of_lists(docs, odd):
    for df in (docs, odd):
        rows = {r.doc_id: (r.text or "") for r in df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()}
        prints = {r.doc_id: r.fingerprint for r in fingerprints(df).collect() if r.doc_id is not None}
        bags = {}
        for i, text in rows.items():
            t = tree(text)
            shown = "/".join(".".join("".join(digest(x).hex()[:6] for x in p) for p in s) for s in t)
            assert prints[i] == digest(t).hex() + ":" + shown
            bags[i] = sorted(digest(x).hex()[:6] for s in t for p in s for x in p)
        ids = sorted(rows)
        for a, b in zip(ids, ids[1:]):
            x, y, shared = list(bags[a]), list(bags[b]), 0
            for leaf in x:
                if leaf in y:
                    y.remove(leaf)
                    shared += 1
            both = len(bags[a]) + len(bags[b])
            want = 1.0 if digest(tree(rows[a])) == digest(tree(rows[b])) else 2 * shared / both if both else 0.0
            assert abs(likeness(prints[a], prints[b]) - want) < 1e-12
