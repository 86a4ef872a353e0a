"""Comparisons of columns and of arrays: label scores, rank agreement, distances between signals, and checks of inputs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.neural import matrix
from quarry.functions.spectra import lifted
from quarry.functions.waves import let, mean

_c = lambda x: F.col(x) if isinstance(x, str) else x
#: A table of counts by pairs of values that is compared with itself, or sent to the driver, has so many rows at most.
MOST_PAIRS = 20_000


def label_scores(df: DataFrame, truth: str, found: str, positive=1) -> DataFrame:
    """specificity, jaccard, zero_one_loss and the number of misses: one aggregate."""
    t, p = F.col(truth) == F.lit(positive), F.col(found) == F.lit(positive)
    n = lambda c: F.count_if(c)
    return df.filter(F.col(truth).isNotNull() & F.col(found).isNotNull()).agg(
        F.coalesce(F.try_divide(n(~t & ~p), n(~t)), F.lit(0.0)).alias("specificity"), F.coalesce(F.try_divide(n(t & p), n(t | p)), F.lit(0.0)).alias("jaccard"),
        F.avg((F.col(truth) != F.col(found)).cast("double")).alias("zero_one_loss"), n(F.col(truth) != F.col(found)).alias("misses"))


def mahalanobis(a, b, inverse: Sequence[Sequence[float]]) -> Column:
    """sqrt(d' V d) of the difference, with a fixed inverse covariance."""
    d = F.zip_with(_c(a), _c(b), lambda x, y: x - y)
    product = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return let(d, lambda v: F.sqrt(product(v, F.transform(matrix(inverse), lambda row: product(row, v)))))


def wasserstein(a, b) -> Column:
    """Mean distance between two equally long arrays in order of size."""
    return mean(F.zip_with(F.array_sort(_c(a)), F.array_sort(_c(b)), lambda x, y: F.abs(x - y)))


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n of rows without nulls, refused beyond MOST_PAIRS."""
    found = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    if found.limit(MOST_PAIRS + 1).count() > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of values; put them in bins first")
    return found


def kendall_tau(df: DataFrame, a: str, b: str) -> DataFrame:
    """tau: (concordant - discordant) / (concordant + discordant) pairs of rows; ties in either column take no part. Pairs of values are compared, not of rows."""
    counts = pair_counts(df, a, b)
    x, y = counts.alias("x"), counts.alias("y")
    pairs = x.join(y, (F.col("x.a") < F.col("y.a")) & (F.col("x.b") != F.col("y.b"))).select((F.col("x.n") * F.col("y.n")).alias("n"), (F.col("x.b") < F.col("y.b")).alias("up"))
    up = F.coalesce(F.sum(F.when(F.col("up"), F.col("n"))), F.lit(0))
    down = F.coalesce(F.sum(F.when(~F.col("up"), F.col("n"))), F.lit(0))
    return pairs.agg(F.coalesce(F.try_divide((up - down).cast("double"), (up + down).cast("double")), F.lit(0.0)).alias("tau"))


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> float:
    """(MI - expected MI) / (max of both entropies - expected MI), expected for shuffled labels."""
    rows, left, right = pair_counts(df, a, b).collect(), {}, {}
    for r in rows:
        left[r["a"]], right[r["b"]] = left.get(r["a"], 0) + r["n"], right.get(r["b"], 0) + r["n"]
    n = sum(left.values())
    if not n or len(left) == len(right) == 1:
        return 1.0
    mi = sum(r["n"] / n * math.log(n * r["n"] / (left[r["a"]] * right[r["b"]])) for r in rows)
    entropy = lambda sizes: -sum(k / n * math.log(k / n) for k in sizes.values())
    lg, expected = math.lgamma, 0.0
    for p in left.values():
        for q in right.values():
            fixed = lg(p + 1) + lg(q + 1) + lg(n - p + 1) + lg(n - q + 1) - lg(n + 1)
            for k in range(max(1, p + q - n), min(p, q) + 1):
                expected += k / n * math.log(n * k / (p * q)) * math.exp(fixed - lg(k + 1) - lg(p - k + 1) - lg(q - k + 1) - lg(n - p - q + k + 1))
    most = max(entropy(left), entropy(right))
    return 1.0 if abs(most - expected) < 1e-15 else (mi - expected) / (most - expected)


def _warped(a, b, window):
    import numpy as np

    n, m = len(a), len(b)
    band = max(window, abs(n - m)) if window is not None else max(n, m)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    return cost


def dtw_distance(a, b, window: int | None = None) -> Column:
    """Least sum of absolute differences over all alignments of two arrays, within a band of places."""
    return lifted(lambda x, y: float(_warped(x, y, window)[len(x), len(y)]), "double", a, b)


def dtw_path(a, b, window: int | None = None) -> Column:
    """Rows (place in a, place in b) of one best alignment."""
    def kernel(x, y):
        import numpy as np

        cost, i, j, out = _warped(x, y, window), len(x), len(y), []
        while i and j:
            out.append((i - 1, j - 1))
            i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: cost[p])
        return np.array(out[::-1], float).reshape(-1, 2)

    return lifted(kernel, "array<array<double>>", a, b)


def check_matrix(df: DataFrame, columns: Sequence[str], label: str | None = None, weight: str | None = None) -> int:
    """The number of rows of a usable table: columns there and numeric, at least one row,
    no missing or infinite number, a label without nulls, weights of 0 or more. One aggregate; ValueError else."""
    wanted = [*columns, *([label] if label else []), *([weight] if weight else [])]
    missing = [c for c in wanted if c not in df.columns]
    if missing or not columns:
        raise ValueError(f"columns missing: {missing}" if missing else "no feature columns")
    types = dict(df.dtypes)
    words = [c for c in columns if types[c] in ("string", "boolean", "binary") or types[c].startswith(("array", "struct", "map"))]
    if words:
        raise ValueError(f"not numeric: {words}")
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    tests = [F.count_if(bad(c)).alias(c) for c in columns]
    tests += [F.count_if(F.col(label).isNull()).alias("label: null")] if label else []
    tests += [F.count_if(bad(weight) | (F.col(weight) < 0)).alias("weight: missing or below 0")] if weight else []
    row = df.agg(F.count("*").alias("rows"), *tests).first().asDict()
    n = row.pop("rows")
    wrong = {k: v for k, v in row.items() if v}
    if not n or wrong:
        raise ValueError("no rows" if not n else f"unusable values: {wrong}")
    return n
