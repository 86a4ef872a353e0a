"""Scores of unlike rows. Fits are aggregates or bounded samples; scores are projections."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.state import checkpointed


class HBOS:
    """Histograms of equal width by column: the score is the sum of minus the logarithms of the densities; values beyond a histogram count as in an empty bin."""

    def __init__(self, columns: Sequence[str], bins: int = 10):
        self.columns, self.bins, self.state = list(columns), bins, None

    def fit(self, df: DataFrame) -> HBOS:
        edges = df.agg(*(f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(self.columns) for k, f in (("a", F.min), ("b", F.max))), F.count("*").alias("n")).first()
        out = HBOS(self.columns, self.bins)
        out.state = {"n": edges["n"], "edges": {c: (edges[f"a{i}"], edges[f"b{i}"]) for i, c in enumerate(self.columns)}}
        rows = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), out._bin(c).alias("k")) for i, c in enumerate(self.columns)))).alias("x")).groupBy("x.c", "x.k").count().collect()
        counts = {c: [0] * self.bins for c in self.columns}
        for r in rows:
            if r["k"] is not None:
                counts[self.columns[r["c"]]][r["k"]] = r["count"]
        out.state["counts"] = counts
        return out

    def _bin(self, c):
        low, high = self.state["edges"][c]
        width = (high - low) / self.bins or 1.0
        k = F.floor((F.col(c).cast("double") - low) / width).cast("int")
        return F.when(F.col(c) == high, self.bins - 1).when((F.col(c) >= low) & (F.col(c) < high), F.least(k, F.lit(self.bins - 1)))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        total = F.lit(0.0)
        for c in self.columns:
            low, high = self.state["edges"][c]
            width = (high - low) / self.bins or 1.0
            logs = [-math.log(max(k, 0.5) / self.state["n"] / width) for k in self.state["counts"][c]]
            total = total + F.coalesce(F.get(F.array(*map(F.lit, logs)), self._bin(c)), F.lit(-math.log(0.5 / self.state["n"] / width)))
        return df.withColumn(name, total)


class EllipticEnvelope:
    """Squared Mahalanobis distance to the mean, by one aggregate of products; ridge is added to the variances."""

    def __init__(self, columns: Sequence[str], ridge: float = 1e-9):
        self.columns, self.ridge, self.state = list(columns), ridge, None

    def fit(self, df: DataFrame) -> EllipticEnvelope:
        import numpy as np

        p = len(self.columns)
        v = [F.col(c).cast("double") for c in self.columns]
        row = df.dropna(subset=self.columns).agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(v)), *(F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p))).first()
        cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) + self.ridge * np.eye(p)
        out = EllipticEnvelope(self.columns, self.ridge)
        out.state = ([row[f"m{i}"] for i in range(p)], np.linalg.inv(cov))
        return out

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        means, inverse = self.state
        d = [F.col(c).cast("double") - m for c, m in zip(self.columns, means)]
        return df.withColumn(name, sum((float(inverse[i][j]) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0)))


def path_length(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n leaves."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Random cuts isolate unlike rows early. Each tree learns from sample rows, taken by a seeded
    hash of the row, so what reaches the driver is trees * sample rows whatever the
    table's size. The score is 2 ** (-mean depth / expected depth): near 1 for unlike rows."""

    def __init__(self, columns: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 0):
        self.columns, self.trees, self.sample, self.seed, self.state = list(columns), trees, sample, seed, None

    def fit(self, df: DataFrame) -> IsolationForest:
        import random

        import numpy as np

        rows = df.select(*(F.col(c).cast("double").alias(c) for c in self.columns)).dropna()
        taken = rows.orderBy(F.xxhash64(*self.columns, F.lit(self.seed)), *self.columns).limit(self.trees * self.sample).collect()
        r, out = random.Random(self.seed), IsolationForest(self.columns, self.trees, self.sample, self.seed)
        points = np.array([list(x) for x in taken], float).reshape(-1, len(self.columns))
        deepest = max(1, math.ceil(math.log2(max(2, min(self.sample, len(points))))))

        def grow(part, depth):
            spread = part.max(axis=0) > part.min(axis=0) if len(part) else np.zeros(0, bool)
            if depth >= deepest or len(part) <= 1 or not spread.any():
                return depth + path_length(len(part))
            k = r.choice(np.flatnonzero(spread).tolist())
            cut = r.uniform(part[:, k].min(), part[:, k].max())
            return k, cut, grow(part[part[:, k] < cut], depth + 1), grow(part[part[:, k] >= cut], depth + 1)

        forest = [grow(points[r.sample(range(len(points)), min(self.sample, len(points)))], 0) for _ in range(self.trees)] if len(points) else []
        out.state = (forest, path_length(min(self.sample, len(points))) or 1.0)
        return out

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        forest, usual = self.state

        def depth(tree, x):
            import numpy as np

            if not isinstance(tree, tuple):
                return np.full(len(x), float(tree))
            k, cut, less, more = tree
            low, out = x[:, k] < cut, np.empty(len(x))
            out[low], out[~low] = depth(less, x[low]), depth(more, x[~low])
            return out

        @F.pandas_udf("double")
        def scored(values):
            import numpy as np
            import pandas as pd

            x = np.array(values.tolist(), float).reshape(len(values), -1)
            return pd.Series(2.0 ** (-np.mean([depth(t, x) for t in forest], axis=0) / usual) if forest else np.full(len(x), 0.5))

        return df.withColumn(name, scored(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.columns))))


def grubbs(df: DataFrame, column: str) -> DataFrame:
    """The value furthest from the mean in sample deviations: one row of value, g and n."""
    moments = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.count(column).alias("n"))
    far = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(moments)).select((F.abs(F.col(column) - F.col("m")) / F.col("s")).alias("g"), F.col(column).alias("value"), "n")
    return far.agg(F.max(F.struct("g", "value", "n")).alias("x")).select("x.value", "x.g", "x.n")


def local_outlier_factor(near: DataFrame) -> DataFrame:
    """id, lof from a table of query, id, distance, rank that holds every row's k nearest
    rows (neighbors.neighbors): the mean density of a row's neighbours over its own.

    near is read four times, so it is kept: finding the neighbours is the work."""
    near = checkpointed(near)
    reach = near.groupBy("query").agg(F.max("distance").alias("k_distance")).select(F.col("query").alias("id"), "k_distance")
    density = near.join(reach, "id").groupBy("query").agg((F.count("*") / F.greatest(F.sum(F.greatest("distance", "k_distance")), F.lit(1e-12))).alias("density"))
    other = density.select(F.col("query").alias("id"), F.col("density").alias("theirs"))
    return near.select("query", "id").join(other, "id").join(density, "query").groupBy("query").agg((F.avg("theirs") / F.first("density")).alias("lof")).select(F.col("query").alias("id"), "lof")
