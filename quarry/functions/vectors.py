"""Distances, similarities and kernels of array columns, as native expressions.

Both arrays have one length; every function returns a double column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _over(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")).cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _over(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _over(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _over(a, b, lambda x, y: F.abs(x - y))


def minkowski(a: Column, b: Column, p: float = 2.0) -> Column:
    return F.pow(_over(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1.0 / p))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(TINY))


def cosine(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)


def hamming(a: Column, b: Column) -> Column:
    return _over(a, b, lambda x, y: (x != y).cast("double")) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as truth values; 0 if both are all false."""
    both, some = _over(a, b, lambda x, y: ((x != 0) & (y != 0)).cast("double")), _over(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("double"))
    return F.when(some > 0, (some - both) / some).otherwise(F.lit(0.0))


def canberra(a: Column, b: Column) -> Column:
    return _over(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0))


def bray_curtis(a: Column, b: Column) -> Column:
    total = _over(a, b, lambda x, y: F.abs(x + y))
    return F.when(total > 0, manhattan(a, b) / total).otherwise(F.lit(0.0))


def rbf_kernel(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * squared_euclidean(a, b))


def laplacian_kernel(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * manhattan(a, b))


def poly_kernel(a: Column, b: Column, gamma: float, coef0: float = 0.0, degree: int = 3) -> Column:
    return F.pow(gamma * dot(a, b) + coef0, F.lit(degree))


def sigmoid_kernel(a: Column, b: Column, gamma: float, coef0: float = 0.0) -> Column:
    return F.tanh(gamma * dot(a, b) + coef0)


def additive_chi2_kernel(a: Column, b: Column) -> Column:
    return -_over(a, b, lambda x, y: F.when(F.abs(x + y) > TINY, (x - y) * (x - y) / (x + y)).otherwise(0.0))


def chi2_kernel(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(gamma * additive_chi2_kernel(a, b))


def hellinger_kernel(a: Column, b: Column) -> Column:
    """Of non-negative arrays."""
    return _over(a, b, lambda x, y: F.sqrt(F.greatest(x, F.lit(0.0)) * F.greatest(y, F.lit(0.0))))


def softmax(a: Column) -> Column:
    """Array of shares exp(x) / sum, shifted by the largest for safety."""
    shifted = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a).cast("double")))
    return F.transform(shifted, lambda x: x / _sum(shifted))


def unit(a: Column, kind: str = "l2") -> Column:
    """The array over its norm ("l1", "l2" or "max"); zero arrays stay."""
    size = {"l1": _sum(F.transform(a, lambda x: F.abs(x.cast("double")))), "l2": norm(a), "max": F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))}[kind]
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": euclidean, "sqeuclidean": squared_euclidean, "manhattan": manhattan, "chebyshev": chebyshev, "cosine": cosine,
    "hamming": hamming, "jaccard": jaccard, "canberra": canberra, "bray_curtis": bray_curtis, "minkowski": minkowski,
}
