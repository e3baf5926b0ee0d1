"""Column builders over array<float|double> columns; all stay in the JVM."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Below this a norm counts as zero.
TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once for a row; a lambda's body would work it out anew for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unit(a: Column) -> Column:
    """The vector over its norm; a zero vector stays zero."""
    over = lambda v: once(F.greatest(norm(v), F.lit(TINY)), lambda n: F.transform(v, lambda x: x.cast("double") / n))
    return once(a, over)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 if either vector is zero."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))))


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(a)


def centred(a: Column) -> Column:
    return once(a, lambda v: once(mean_of(v), lambda m: F.transform(v, lambda x: x.cast("double") - m)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - cosine(a, b))


def softmax(score: Column, *by: str) -> Column:
    """Softmax of a score over the rows that share the columns ``by``."""
    w = Window.partitionBy(*by)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def logsumexp(score: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    m = F.max(score).over(w)
    return m + F.log(F.sum(F.exp(score - m)).over(w))


def entropy_term(p: Column) -> Column:
    return -p * F.log(F.greatest(p, F.lit(TINY)))


def normalised(entropy: Column, n: Column) -> Column:
    """Entropy over that of ``n`` equal parts; 0 for one part or none."""
    return F.when(n > 1, entropy / F.log(n.cast("double"))).otherwise(F.lit(0.0))


def projection_signs(length: int, dims: int, seed: int) -> list[list[float]]:
    """Rows of signs drawn from a hash of (seed, row, column)."""
    return [[1.0 if hashlib.sha256(f"{seed}:{j}:{i}".encode()).digest()[0] < 128 else -1.0 for i in range(length)] for j in range(dims)]


def random_projection(a: Column, length: int, dims: int, seed: int) -> Column:
    """A vector of ``length`` numbers times rows of signs, over the root of ``dims``."""
    return F.transform(F.lit(projection_signs(length, dims, seed)), lambda row: dot(a, row) / math.sqrt(dims))


def kappa(resultant: Column, dims: int, largest: float = 100.0) -> Column:
    """Moment estimate of a von Mises-Fisher concentration from the mean resultant length."""
    r = F.least(F.greatest(resultant, F.lit(0.0)), F.lit(1.0))
    return F.when(r <= 0, F.lit(0.0)).when(r >= 1, F.lit(largest)).otherwise(F.least(F.lit(largest), r * (dims - r * r) / (1 - r * r)))


def sphere_log_density(dims: int) -> float:
    """Of the uniform distribution on the unit sphere."""
    return math.lgamma(dims / 2) - math.log(2) - dims / 2 * math.log(math.pi)


def vmf_log_normalizer(k: Column, dims: int) -> Column:
    """Debye's uniform expansion of the Bessel function, for many dimensions (32 and more)."""
    v = dims / 2 - 1
    z = k / v
    root = F.sqrt(1 + z * z)
    t = 1 / root
    eta = root + F.log(z / (1 + root))
    # u1 and u2 of the expansion in powers of t / v
    u1 = (3 * t - 5 * F.pow(t, 3)) / 24
    u2 = (81 * F.pow(t, 2) - 462 * F.pow(t, 4) + 385 * F.pow(t, 6)) / 1152
    log_bessel = v * eta - 0.5 * math.log(2 * math.pi * v) - 0.5 * F.log(root) + F.log1p(u1 / v + u2 / (v * v))
    return F.when(k <= 1e-8, F.lit(sphere_log_density(dims))).otherwise(v * F.log(k) - dims / 2 * math.log(2 * math.pi) - log_bessel)


def log_bessel(order: float, x: float) -> float:
    """Log of the modified Bessel function of the first kind: Debye's expansion for large orders, an asymptotic one for large x, else the power series."""
    if order >= 15:
        z = x / order
        root = math.sqrt(1 + z * z)
        t = 1 / root
        u1, u2 = (3 * t - 5 * t**3) / 24, (81 * t**2 - 462 * t**4 + 385 * t**6) / 1152
        return order * (root + math.log(z / (1 + root))) - 0.5 * math.log(2 * math.pi * order * root) + math.log1p(u1 / order + u2 / order**2)
    if x > 50 + order * order:
        m = 4 * order * order
        return x - 0.5 * math.log(2 * math.pi * x) + math.log1p(-(m - 1) / (8 * x) + (m - 1) * (m - 9) / (2 * (8 * x) ** 2) - (m - 1) * (m - 9) * (m - 25) / (6 * (8 * x) ** 3))
    k = np.arange(int(x) * 2 + 60)
    terms = (2 * k + order) * math.log(x / 2) - np.array([math.lgamma(i + 1) + math.lgamma(i + order + 1) for i in k])
    top = terms.max()
    return float(top + math.log(np.exp(terms - top).sum()))


def vmf_density(cosine: float, kappa: float, dims: int) -> float:
    """Log density at a cosine to the mean direction; for any number of dimensions."""
    if kappa <= 1e-12:
        return sphere_log_density(dims)
    v = dims / 2 - 1
    return v * math.log(kappa) - dims / 2 * math.log(2 * math.pi) - log_bessel(v, kappa) + kappa * cosine


def vmf_densities(cosine: np.ndarray, kappa: np.ndarray, dims: int) -> np.ndarray:
    """Log densities of many; at once where Debye's expansion holds."""
    v = dims / 2 - 1
    if v < 15:
        return np.array([vmf_density(c, k, dims) for c, k in zip(cosine, kappa)])
    k = np.maximum(kappa, 1e-12)
    z = k / v
    root = np.sqrt(1 + z * z)
    t = 1 / root
    bessel = v * (root + np.log(z / (1 + root))) - 0.5 * np.log(2 * math.pi * v * root) + np.log1p((3 * t - 5 * t**3) / 24 / v + (81 * t**2 - 462 * t**4 + 385 * t**6) / 1152 / v**2)
    return np.where(kappa <= 1e-12, sphere_log_density(dims), v * np.log(k) - dims / 2 * math.log(2 * math.pi) - bessel + k * cosine)


def vmf_log_density(cosine: Column, kappa: Column, dims: int) -> Column:
    """The same as a column, in Arrow batches; for 32 dimensions and more ``vmf_log_normalizer`` stays in the JVM."""

    @F.pandas_udf("double")
    def density(c: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([vmf_density(x, y, dims) for x, y in zip(c, k)], dtype=float)

    return density(cosine, kappa)


def record_weight(now: Column, written: Column, used: Column, gain: Column, superseded: Column, active: Column, *, age_decay: float = 0.0, idle_decay: float = 0.0, floor: float = 1e-6, gain_power: float = 0.0) -> Column:
    """active * exp(-a * age) * exp(-b * idle) * (floor + gain) ** power * (1 - superseded)."""
    age, idle = F.greatest(now - written, F.lit(0.0)), F.greatest(now - used, F.lit(0.0))
    return F.when(active, F.exp(-age_decay * age) * F.exp(-idle_decay * idle) * F.pow(floor + F.greatest(gain, F.lit(0.0)), F.lit(gain_power)) * (1 - superseded)).otherwise(F.lit(0.0))


def native_score(query: Column, key: Column, now: Column, written: Column, authority: Column, count: Column, *, dims: int, time_bias: float = 0.0, authority_bias: float = 0.0) -> Column:
    """q.k / sqrt(d), a bonus for what is recent, one for authority, and the log of the count."""
    return dot(query, key) / math.sqrt(dims) + time_bias / (1 + F.abs(now - written)) + authority_bias * authority + F.log(count.cast("double"))
