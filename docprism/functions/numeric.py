"""Numbers, vectors and intervals as columns."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def mean_pool(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def even_indices(n: Column, limit: int) -> Column:
    """At most ``limit`` evenly spaced indices of ``n`` items."""
    k = F.least(n, F.lit(limit))
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("long"))
    return F.when(n > 0, spread).otherwise(F.array().cast("array<bigint>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def zero_event_bound(n: Column, confidence: float = 0.95) -> Column:
    """Exact one-sided upper bound of a rate with no event in ``n``; null without trials."""
    return F.when(n > 0, -F.expm1(F.lit(math.log1p(-confidence)) / F.greatest(n, F.lit(1))))


def wilson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds; null without trials."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    p = F.try_divide(k, n)
    base = 1 + F.try_divide(F.lit(z * z), n)
    mid = (p + F.try_divide(F.lit(z * z / 2), n)) / base
    half = F.lit(z) * F.sqrt(F.greatest(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n.cast("double") * n), F.lit(0.0))) / base
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))), F.when(n > 0, F.least(mid + half, F.lit(1.0)))  # greatest() skips nulls


def beta_upper(k: int, n: int, confidence: float = 0.95) -> float | None:
    """Exact one-sided upper bound of ``k`` events in ``n``, by bisection on the binomial tail."""
    if n <= 0:
        return None
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(80):
        p = (low + high) / 2
        tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) if 0 < p < 1 else float(p == 0)
        low, high = (p, high) if tail > 1 - confidence else (low, p)
    return high


def covers(outer: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the rectangle (struct x0, y0, x1, y1) contains the other fully."""
    return (outer["x0"] <= x0) & (outer["y0"] <= y0) & (outer["x1"] >= x1) & (outer["y1"] >= y1)
