"""Measures that SQL doesn't express, against plain code."""

import difflib
import math

from mnemolith.functions import text, vector
from mnemolith.operators import trajectory


def test_sequence_ratio(spark):
    rows = [("abcd", "bcde"), ("", ""), ("a b c", "c b a"), ("same", "same"), ("x" * 300, "xy" * 150)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(2)
    got = {(r.a, r.b): r.r for r in df.select("a", "b", text.sequence_ratio(df.a, df.b).alias("r")).collect()}
    assert got == {(a, b): difflib.SequenceMatcher(None, a, b).ratio() for a, b in rows}


def test_banded_warping(spark):
    def cost(u, v):
        n = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
        return max(0.0, 1 - sum(x * y for x, y in zip(u, v)) / n)

    def plain(a, b, band):
        width, memo = max(band, abs(len(a) - len(b))), {}

        def best(i, j):
            if (i, j) == (0, 0):
                return 0.0
            if i == 0 or j == 0 or abs(i - j) > width:
                return math.inf
            if (i, j) not in memo:
                memo[i, j] = cost(a[i - 1], b[j - 1]) + min(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1))
            return memo[i, j]

        return best(len(a), len(b)) / max(len(a), len(b))

    pairs = [([[math.sin(k + s), math.cos(k * s + 1), 0.5] for k in range(n)], [[math.cos(k), math.sin(k * s), 1.0] for k in range(m)]) for n, m, s in ((5, 5, 1), (8, 3, 2), (1, 4, 3), (12, 10, 1))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, left array<array<double>>, right array<array<double>>")
    for band in (1, 3):
        got = {r.i: r.distance for r in trajectory.dtw(df, band).collect()}
        assert all(abs(got[i] - plain(*p, band)) < 1e-9 for i, p in enumerate(pairs))


def test_von_mises_fisher_normaliser():
    """In three dimensions there is a closed form; the expansions meet the series where both hold."""
    for k in (0.5, 3.0, 40.0, 200.0):
        closed = math.log(k) - math.log(4 * math.pi) - (k + math.log((1 - math.exp(-2 * k)) / 2)) + 0.3 * k
        assert abs(vector.vmf_density(0.3, k, 3) - closed) < 1e-8
    import numpy as np

    many = vector.vmf_densities(np.array([0.1, 0.9, 0.5]), np.array([0.0, 5.0, 80.0]), 64)
    assert all(abs(m - vector.vmf_density(c, k, 64)) < 1e-9 for m, c, k in zip(many, (0.1, 0.9, 0.5), (0.0, 5.0, 80.0)))


def test_indices():
    assert text.parse_indices("all") is None and text.parse_indices(" 3-5, 1,4 ") == (1, 3, 4, 5)
    for bad in ("5-3", " , ", "x"):
        try:
            text.parse_indices(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
