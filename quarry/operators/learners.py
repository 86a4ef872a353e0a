"""Models that are learnt from sums: one aggregate (or one a round) gives what the driver solves, whatever the table's size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, names: Sequence[str], target: str, weight: Column | None = None):
    """Gram matrix and products with the target, of 1 and the features, by one aggregate."""
    import numpy as np

    w = F.lit(1.0) if weight is None else weight
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in names)]
    y, p = F.col(target).cast("double"), len(names) + 1
    row = df.dropna(subset=[*names, target]).agg(*(F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)), *(F.sum(w * x[i] * y).alias(f"b{i}") for i in range(p))).first()
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    return gram, np.array([row[f"b{i}"] or 0.0 for i in range(p)])


def _named(names: Sequence[str], beta) -> dict[str, float]:
    return dict(zip(["intercept", *names], map(float, beta)))


def predicted(df: DataFrame, model: dict[str, float], name: str = "predicted") -> DataFrame:
    return df.withColumn(name, sum((F.lit(v) * F.col(k).cast("double") for k, v in model.items() if k != "intercept"), F.lit(model["intercept"])))


def elastic_net(df: DataFrame, names: Sequence[str], target: str, alpha: float = 1.0, l1_ratio: float = 0.5, rounds: int = 1000, tolerance: float = 1e-10) -> dict[str, float]:
    """Mean squared error / 2 + alpha * (l1_ratio * |b| + (1 - l1_ratio) / 2 * b^2), by
    coordinate descent on the centred Gram matrix; the intercept isn't shrunk."""
    import numpy as np

    gram, right = moments(df, names, target)
    n = gram[0, 0]
    means, top = gram[0, 1:] / n, right[0] / n
    g, b = gram[1:, 1:] / n - np.outer(means, means), right[1:] / n - means * top
    beta = np.zeros(len(names))
    for _ in range(rounds):
        before = beta.copy()
        for k in range(len(beta)):
            rho = b[k] - g[k] @ beta + g[k, k] * beta[k]
            size = max(abs(rho) - alpha * l1_ratio, 0.0)
            beta[k] = math.copysign(size, rho) / (g[k, k] + alpha * (1 - l1_ratio)) if size and g[k, k] + alpha * (1 - l1_ratio) > 0 else 0.0
        if np.abs(beta - before).max(initial=0.0) <= tolerance * max(1.0, np.abs(beta).max(initial=0.0)):
            break
    return _named(names, [top - means @ beta, *beta])


def lasso(df, names, target, alpha: float = 1.0, **more) -> dict[str, float]:
    return elastic_net(df, names, target, alpha, 1.0, **more)


def reweighted(df: DataFrame, names: Sequence[str], target: str, weight, rounds: int = 20, tolerance: float = 1e-8) -> dict[str, float]:
    """Least squares, again with weight(residual) until the coefficients stay: one aggregate a round."""
    import numpy as np

    model, w = None, None
    for _ in range(rounds):
        gram, right = moments(df, names, target, w)
        new = _named(names, np.linalg.lstsq(gram, right, rcond=None)[0])
        if model and max(abs(new[k] - model[k]) for k in new) <= tolerance * max(1.0, *(abs(v) for v in new.values())):
            return new
        model = new
        found = sum((F.lit(v) * F.col(k).cast("double") for k, v in model.items() if k != "intercept"), F.lit(model["intercept"]))
        w = weight(F.col(target).cast("double") - found)
    return model


def huber(df, names, target, delta: float = 1.35, **more) -> dict[str, float]:
    """Squares up to delta, straight beyond."""
    return reweighted(df, names, target, lambda r: F.when(F.abs(r) <= delta, 1.0).otherwise(delta / F.abs(r)), **more)


def quantile_regression(df, names, target, share: float = 0.5, rounds: int = 60, **more) -> dict[str, float]:
    return reweighted(df, names, target, lambda r: F.when(r >= 0, share).otherwise(1 - share) / F.greatest(F.abs(r), F.lit(1e-6)), rounds, **more)


def bernoulli_nb(df: DataFrame, names: Sequence[str], label: str, alpha: float = 1.0, threshold: float = 0.0) -> DataFrame:
    """label, n, and the smoothed chance of each feature to be above the threshold."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *(((F.count_if(F.col(c) > threshold) + alpha) / (F.count("*") + 2 * alpha)).alias(f"p_{c}") for c in names))


def multinomial_nb(df: DataFrame, names: Sequence[str], label: str, alpha: float = 1.0) -> DataFrame:
    """label, n, and the logarithm of each feature's smoothed share of a class's counts."""
    sums = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *(F.sum(c).cast("double").alias(f"s_{c}") for c in names))
    total = sum((F.col(f"s_{c}") for c in names), F.lit(0.0)) + alpha * len(names)
    return sums.select("label", "n", *(F.log((F.col(f"s_{c}") + alpha) / total).alias(f"log_{c}") for c in names))


def discriminant(df: DataFrame, names: Sequence[str], label: str, shared: bool = False, ridge: float = 1e-9) -> dict:
    """Means and covariances by class (shared: one covariance, weighed by class): quadratic or linear discriminant analysis."""
    import numpy as np

    v, p = [F.col(c).cast("double") for c in names], len(names)
    rows = df.dropna(subset=[*names, label]).groupBy(label).agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(v)), *(F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p))).collect()
    total = sum(r["n"] for r in rows)
    cov = {r[label]: np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) for r in rows}
    if shared:
        mean = sum(r["n"] * cov[r[label]] for r in rows) / total
        cov = dict.fromkeys(cov, mean)
    return {r[label]: (r["n"] / total, [r[f"m{i}"] for i in range(p)], cov[r[label]] + ridge * np.eye(p)) for r in rows}


def discriminant_predict(df: DataFrame, names: Sequence[str], model: dict, name: str = "predicted") -> DataFrame:
    """The class of the highest log density and prior; the model's few classes are literals."""
    import numpy as np

    scores = []
    for label, (prior, means, cov) in sorted(model.items()):
        inverse, d = np.linalg.inv(cov), [F.col(c).cast("double") - m for c, m in zip(names, means)]
        far = sum((float(inverse[i][j]) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
        scores.append(F.struct((math.log(prior) - 0.5 * float(np.linalg.slogdet(cov)[1]) - 0.5 * far).alias("s"), F.lit(label).alias("label")))
    return df.withColumn(name, F.array_max(F.array(*scores))["label"])


def knn_regression(found: DataFrame, values: DataFrame, id_col: str, value: str, weights: str = "uniform") -> DataFrame:
    """query, predicted: the neighbours' mean value, or weighed by one over the distance."""
    w = F.lit(1.0) if weights == "uniform" else 1.0 / F.greatest(F.col("distance"), F.lit(1e-12))
    rows = found.join(values.select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("_v")), "id")
    return rows.groupBy("query").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("predicted"))


def voted(df: DataFrame, columns: Sequence[str], name: str = "predicted") -> DataFrame:
    """The value most of the columns hold; ties go to the least."""
    votes = F.array(*map(F.col, columns))
    best = F.array_max(F.transform(F.array_distinct(votes), lambda v: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), (-v).alias("o"))))
    return df.withColumn(name, -best["o"])


# Bandits: scores of arms from what they gave so far, one row an arm.


def arms(df: DataFrame, arm: str, reward: str) -> DataFrame:
    return df.groupBy(F.col(arm).alias("arm")).agg(F.count(reward).alias("n"), F.avg(reward).alias("mean"))


def _over_all(f):
    from pyspark.sql import Window

    return f.over(Window.partitionBy(F.lit(1)))


def ucb(stats: DataFrame, c: float = 2.0) -> DataFrame:
    """Mean and sqrt(c * ln(all pulls) / own pulls)."""
    return stats.withColumn("score", F.col("mean") + F.sqrt(c * F.log(_over_all(F.sum("n"))) / F.col("n")))


def softmax_policy(stats: DataFrame, temperature: float = 1.0) -> DataFrame:
    top = _over_all(F.max("mean"))
    e = F.exp((F.col("mean") - top) / temperature)
    return stats.withColumn("e", e).withColumn("chance", F.col("e") / _over_all(F.sum("e"))).drop("e")


def epsilon_greedy(stats: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """The best arm (ties to the least) by 1 - epsilon, the rest shared evenly."""
    best = _over_all(F.max(F.struct("mean")))["mean"]
    first = _over_all(F.min(F.when(F.col("mean") == F.col("_best"), F.col("arm"))))
    rows = stats.withColumn("_best", best).withColumn("_first", first)
    return rows.withColumn("chance", epsilon / _over_all(F.count("*")) + F.when(F.col("arm") == F.col("_first"), 1 - epsilon).otherwise(0.0)).drop("_best", "_first")


def linucb(df: DataFrame, arm: str, names: Sequence[str], reward: str, alpha: float = 1.0) -> dict:
    """Ridge coefficients and inverse matrices by arm, from one aggregate; linucb_score() applies them."""
    import numpy as np

    x, p = [F.col(c).cast("double") for c in names], len(names)
    rows = df.groupBy(arm).agg(*(F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)), *(F.sum(x[i] * F.col(reward)).alias(f"b{i}") for i in range(p))).collect()
    out = {}
    for r in rows:
        inverse = np.linalg.inv(np.eye(p) + np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]))
        out[r[arm]] = (inverse @ np.array([r[f"b{i}"] for i in range(p)]), inverse, alpha)
    return out


def linucb_score(df: DataFrame, names: Sequence[str], model: dict) -> DataFrame:
    """Adds arm: the one of the highest mean and width for the row's context."""
    scores = []
    for arm, (theta, inverse, alpha) in sorted(model.items()):
        x = [F.col(c).cast("double") for c in names]
        width = sum((float(inverse[i][j]) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
        scores.append(F.struct((sum((float(t) * v for t, v in zip(theta, x)), F.lit(0.0)) + alpha * F.sqrt(width)).alias("s"), F.lit(arm).alias("arm")))
    return df.withColumn("arm", F.array_max(F.array(*scores))["arm"])


# Estimation and control of linear systems: recursions over a key's rows in order.


def kalman(df: DataFrame, key: str, order: str, value: str, process: float = 1e-2, noise: float = 1.0) -> DataFrame:
    """key, order, estimate, variance of a slowly moving level. A key's series is folded in its task; keys run in parallel.

    Rows are sorted before Python, which holds one batch and the state, not a series.
    """
    def fold(batches):
        import numpy as np
        import pyarrow as pa

        last, m, p = None, None, noise
        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(2).cast("double").fill_null(float("nan")).to_pylist()
            means, spreads = np.empty(len(values)), np.empty(len(values))
            for i, (k, v) in enumerate(zip(keys, values)):
                if last is None or k != last[0]:
                    m, p, last = v, noise, (k,)
                else:
                    p += process
                    gain = p / (p + noise)
                    m, p = m + gain * (v - m), (1 - gain) * p
                means[i], spreads[i] = m, p
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(means), pa.array(spreads)], names=[key, order, "estimate", "variance"])

    types = dict(df.dtypes)
    rows = df.select(key, order, value).repartition(key).sortWithinPartitions(F.col(key), F.asc_nulls_last(order))
    return rows.mapInArrow(fold, f"`{key}` {types[key]}, `{order}` {types[order]}, estimate double, variance double")


def pid(df: DataFrame, key: str, order: str, error: str, kp: float, ki: float, kd: float, dt: float = 1.0) -> DataFrame:
    """Adds control: proportional, integral and differential parts of an error signal, by window sums."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    e = F.col(error).cast("double")
    return df.withColumn("control", kp * e + ki * dt * F.sum(e).over(w.rowsBetween(Window.unboundedPreceding, 0)) + kd * F.coalesce(e - F.lag(e).over(w), F.lit(0.0)) / dt)


def solve_riccati(a, b, q, r, rounds: int = 10_000, tolerance: float = 1e-12):
    """Fixed point of the discrete algebraic Riccati equation and the gain of the optimal regulator."""
    import numpy as np

    a, b, q, r = (np.atleast_2d(np.asarray(x, float)) for x in (a, b, q, r))
    p = q.copy()
    for _ in range(rounds):
        gain = np.linalg.solve(r + b.T @ p @ b, b.T @ p @ a)
        new = q + a.T @ p @ (a - b @ gain)
        if np.abs(new - p).max() <= tolerance * max(1.0, np.abs(p).max()):
            return new, gain
        p = new
    return p, gain
