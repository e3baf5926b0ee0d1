"""The divergence audit against plain counting, over several segments and seats, and whole tables against SQL."""

import re
from collections import Counter

import pytest
from oracle import database, difference
from pyspark.sql import functions as F

from mnemolith.llm import queries
from mnemolith.llm.divergence import _Resident, divergence, partner

SCHEMA = "doc_id long, text string, lang string, source string, n int, value string, seat string"
TEXTS = ["Alpha beta gamma, beta!", "alpha BETA ÄÖ äö", None, "", "beta beta beta gamma-delta", "1234 !!", "naïve ÉCOLE école alpha", "word " * 5000 + "beta", "K ſ İ beta"]


def made():
    rows = []
    for i in range(90):
        lang, source = ["en", "de", None][i % 3 if i % 7 else 2], [f"s{i % 5}", "", None][0 if i % 4 else i % 3]
        rows.append((i, TEXTS[i % len(TEXTS)], lang, source, 1, "v", "x"))
    return rows + rows[:4] + [(500, "only here", "xx", "a", 1, "", ""), (501, None, "xx", "b", 1, "", "")]


def plain(rows, least, top):
    docs, groups = Counter(), {}
    for _, text, lang, source, *_ in rows:
        lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        docs.update((lang or "", w) for w in set(words))
        groups.setdefault((lang or "", source or ""), Counter()).update(words)
    out = {}
    for lang in {k[0] for k in groups}:
        kept = [w for (l, w), n in docs.items() if l == lang and n >= least]
        whole = Counter()
        for (l, _), c in groups.items():
            if l == lang:
                whole.update(c)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        q = share(whole)
        mine = {s: share(c) for (l, s), c in groups.items() if l == lang}
        for s, p in mine.items():
            pairs = [(-sum(abs(p[w] - o[w]) for w in kept), x) for x, o in mine.items() if x != s]
            terms = [(q[w] - p[w], w) for w in kept if groups[lang, s][w] and p[w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (value, item) in enumerate(sorted(found, key=lambda z: (z[0], z[1].encode()))[:most]):
                    out[lang, s, part, item] = (-value, k + 1)
    return out


@pytest.mark.parametrize("given", [{}, {"segment": 2, "residents": 1, "seats": 2}, {"segment": 1, "residents": 2, "seats": 5}])
def test_against_plain_counting(spark, given):
    rows = made()
    got = divergence(spark.createDataFrame(rows, SCHEMA).repartition(4), least_docs=3, top=2, **given).collect()
    found = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in got}
    assert len(found) == len(got)
    assert found == plain(rows, 3, 2)


def test_without_kept_terms_and_without_rows(spark):
    rows = made()
    got = divergence(spark.createDataFrame(rows, SCHEMA), least_docs=1000).collect()
    assert {r.value for r in got} == {0} and {r.part for r in got} == {"pair"}
    assert len(got) == len(plain(rows, 1000, 50))
    assert divergence(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seats", [2, 4, 8, 14])
def test_all_seats_meet_once(spark, seats):
    met = []
    for turn in range(seats - 1):
        rows = spark.range(seats).select("id", partner(F.col("id"), turn, seats).alias("p")).collect()
        assert all(dict((r.id, r.p) for r in rows)[r.p] == r.id != r.p for r in rows)
        met += [(r.id, r.p) for r in rows if r.id < r.p]
    assert sorted(met) == [(a, b) for a in range(seats) for b in range(a + 1, seats)]


def test_both_directions_agree():
    from mnemolith.llm.divergence import _pack
    import numpy as np

    rows = [{"source": s, "vector": _pack(np.array(i), np.array(n)), "total": t, "v": 40} for s, i, n, t in (("a", [0, 3, 9], [5, 1, 2**50], 2**51), ("b", [3, 8], [7, 7], 60), ("c", [], [], 0))]
    seats = [_Resident(12, {**r, "vector": r["vector"] if r["source"] != "c" else None}, 5) for r in rows]
    for a in seats:
        for b in seats:
            assert a.apart(b) == b.apart(a) == int(np.abs(a.dense - b.dense).sum())


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(queries.op11_divergence(spark, sf), database(sf), queries.ORACLE["op11_divergence"]) == ""
