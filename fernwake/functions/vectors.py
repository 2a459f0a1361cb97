"""Vector arithmetic as Spark expressions over array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, eps: float = EPS) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def rbf(distance: Column, gamma: float) -> Column:
    return F.exp(-gamma * distance * distance)


def similarity(raw: Column, metric: str, gamma: float = 1.0) -> Column:
    """Similarity from what a search ranks by: cosine as it is, a distance as 1 / (1 + d) or by an RBF kernel."""
    if metric in ("cosine", "fidelity", "entangled"):
        return raw
    if metric == "euclidean":
        return 1 / (1 + raw)
    if metric == "rbf":
        return rbf(raw, gamma)
    raise ValueError(f"unknown metric {metric}")


def scaled_angles(a: Column, n: int) -> Column:
    return F.transform(F.slice(a, 1, n), lambda x: F.lit(math.pi) * F.tanh(x.cast("double")))


def finite(c: Column) -> Column:
    """``c`` as a double; null where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
