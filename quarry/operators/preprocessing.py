"""Preprocessing: scalers, imputers, encoders, bins and feature scores.

A fit is one aggregate that gives a one-row table (or one row a category); transforms
join it, broadcast where it has one row, and are projections otherwise.
"""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.missing import present
from quarry.functions.quantiles import as_literals, exact_quantiles


def _with_stats(df: DataFrame, names: list[str], **stats) -> DataFrame:
    """df beside one row of aggregates: name_stat columns."""
    aggs = [f(present(df, c)).alias(f"_{k}_{c}") for c in names for k, f in stats.items()]
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def _replace(df: DataFrame, rows: DataFrame, names: list[str], f) -> DataFrame:
    return rows.select(*(f(c).alias(c) if c in names else F.col(c) for c in df.columns))


def standard_scale(df: DataFrame, names: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    rows = _with_stats(df, names, m=F.avg, s=F.stddev_pop)
    return _replace(df, rows, names, lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0))


def minmax_scale(df: DataFrame, names: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """To low..high; a constant column becomes low."""
    rows = _with_stats(df, names, a=F.min, b=F.max)
    span = lambda c: F.when(F.col(f"_b_{c}") > F.col(f"_a_{c}"), F.col(f"_b_{c}") - F.col(f"_a_{c}")).otherwise(1.0)
    return _replace(df, rows, names, lambda c: (F.col(c) - F.col(f"_a_{c}")) / span(c) * (high - low) + low)


def maxabs_scale(df: DataFrame, names: list[str]) -> DataFrame:
    rows = _with_stats(df, names, a=lambda v: F.max(F.abs(v)))
    return _replace(df, rows, names, lambda c: F.col(c) / F.when(F.col(f"_a_{c}") > 0, F.col(f"_a_{c}")).otherwise(1.0))


def robust_scale(df: DataFrame, names: list[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """(x - median) / quantile range, exact quantiles."""
    found = exact_quantiles(df, {c: (present(df, c), [low, 0.5, high]) for c in names})
    q = lambda c, k: as_literals(found[c])[k]
    return _replace(df, df, names, lambda c: (F.col(c) - q(c, 1)) / F.when(q(c, 2) > q(c, 0), q(c, 2) - q(c, 0)).otherwise(1.0))


def impute(df: DataFrame, names: list[str], strategy: str = "mean", fill=None) -> DataFrame:
    """Missing values by "mean", "median", "most_frequent" (ties: the least value) or "constant"; a column without values becomes 0."""
    if strategy == "constant":
        return df.select(*(F.coalesce(present(df, c), F.lit(fill)).alias(c) if c in names else F.col(c) for c in df.columns))
    if strategy == "median":
        found = exact_quantiles(df, {c: (present(df, c), [0.5]) for c in names})
        return _replace(df, df, names, lambda c: F.coalesce(present(df, c), F.lit(found[c][0]).cast("double"), F.lit(0.0)))
    f = {"mean": F.avg, "most_frequent": lambda v: F.mode(v, True)}[strategy]
    rows = _with_stats(df, names, v=f)
    zero = {c: F.lit(0.0) if strategy != "most_frequent" or dict(df.dtypes)[c] != "string" else F.lit("") for c in names}
    return _replace(df, rows, names, lambda c: F.coalesce(present(df, c), F.col(f"_v_{c}"), zero[c]))


def categories(df: DataFrame, name: str) -> DataFrame:
    """value, code: the sorted distinct values numbered from 0."""
    from quarry.operators.folds import numbered

    return numbered(df.select(F.col(name).alias("value")).dropna().distinct(), "value", name="code")


def ordinal_encode(df: DataFrame, name: str, fitted: DataFrame, unknown: int = -1) -> DataFrame:
    """The column's code in fitted (value, code); unknown for values it lacks."""
    return df.join(fitted.select(F.col("value").alias(name), F.col("code").alias("_code")), name, "left").withColumn(name, F.coalesce("_code", F.lit(unknown))).select(*df.columns)


def one_hot(df: DataFrame, name: str, values: list, drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each value, name_value; the column itself goes."""
    kept = values[1:] if drop_first else values
    return df.select(*(c for c in df.columns if c != name), *((F.coalesce(F.col(name) == v, F.lit(False))).cast("double").alias(f"{name}_{v}") for v in kept))


def target_encode(df: DataFrame, name: str, target: str, smoothing: float = 1.0) -> DataFrame:
    """value, n, encoded: (sum of target + smoothing * mean) / (n + smoothing)."""
    mean = df.agg(F.avg(target).alias("_m"))
    per = df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"), F.sum(target).alias("_s"))
    return per.crossJoin(F.broadcast(mean)).select("value", "n", ((F.col("_s") + smoothing * F.col("_m")) / (F.col("n") + smoothing)).alias("encoded"))


def bin_edges(df: DataFrame, name: str, bins: int, strategy: str = "quantile") -> DataFrame:
    """One row: edges, an array of bins + 1 numbers."""
    v = present(df, name)
    if strategy == "quantile":
        edges = exact_quantiles(df, {name: (v, [k / bins for k in range(bins + 1)])})[name]
        return df.sparkSession.range(1).select((F.lit(None).cast("array<double>") if edges[0] is None else as_literals(edges)).alias("edges"))
    ends = df.agg(F.min(v).alias("a"), F.max(v).alias("b"))
    return ends.select(F.array(*(F.col("a") + (F.col("b") - F.col("a")) * k / bins for k in range(bins + 1))).alias("edges"))


def discretize(df: DataFrame, name: str, bins: int, strategy: str = "quantile") -> DataFrame:
    """Adds bin from 0: bins are closed on the left; values beyond the edges go to the end bins."""
    rows = df.crossJoin(F.broadcast(bin_edges(df, name, bins, strategy)))
    below = F.size(F.filter(F.slice("edges", 2, bins - 1), lambda e: F.col(name) >= e))
    return rows.withColumn("bin", below).drop("edges")


def polynomial(df: DataFrame, names: list[str], degree: int = 2, bias: bool = True, interactions_only: bool = False) -> DataFrame:
    """Products of up to degree columns in order of degree, after the other columns; 1 first with bias."""
    pick, out = combinations if interactions_only else combinations_with_replacement, []
    for d in range(0 if bias else 1, degree + 1):
        for group in pick(names, d):
            product: Column = F.lit(1.0)
            for c in group:
                product = product * F.col(c)
            out.append(product.alias("*".join(group) or "1"))
    return df.select(*(c for c in df.columns if c not in names), *out)


def yeo_johnson(x: Column, k: float) -> Column:
    pos = F.log1p(x) if abs(k) < 1e-12 else (F.pow(x + 1, F.lit(k)) - 1) / k
    neg = -F.log1p(-x) if abs(k - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - k)) - 1) / (2 - k)
    return F.when(x >= 0, pos).otherwise(neg)


def power_exponent(df: DataFrame, name: str, steps: int = 101) -> DataFrame:
    """exponent, score: of a grid on -2..2 that with the highest normal likelihood.

    Powers are taken once a distinct value; variances are sums around the power of the mean, weighted by the counts.
    """
    grid = [-2 + 4 * k / (steps - 1) for k in range(steps)]
    x = present(df, name)
    values = df.select(x.alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count("*").cast("double").alias("w"))
    mean = df.agg(F.avg(x).alias("m")).first()["m"]
    x, w = F.col("x"), F.col("w")
    centre = F.lit(mean).cast("double")
    moved = values.select("x", "w", *((yeo_johnson(x, k) - yeo_johnson(centre, k)).alias(f"y{i}") for i, k in enumerate(grid)))
    sums = moved.agg(F.sum("w").alias("n"), F.sum(w * F.signum(x) * F.log1p(F.abs(x))).alias("j"), *(y for i in range(len(grid)) for y in (F.sum(w * F.col(f"y{i}")).alias(f"s{i}"), F.sum(w * F.col(f"y{i}") * F.col(f"y{i}")).alias(f"q{i}"))))
    sums = sums.select("n", "j", *((F.col(f"q{i}") / F.col("n") - F.pow(F.col(f"s{i}") / F.col("n"), 2)).alias(f"v{i}") for i in range(len(grid))))
    scores = F.array(*(F.struct((F.lit(k - 1) * F.col("j") - F.col("n") / 2 * F.ln(F.col(f"v{i}"))).alias("score"), F.lit(k).alias("exponent")) for i, k in enumerate(grid)))
    return sums.select(F.array_max(F.filter(scores, lambda s: s["score"].isNotNull())).alias("s")).select("s.exponent", "s.score")


def feature_variances(df: DataFrame, names: list[str]) -> DataFrame:
    """feature, variance of the population."""
    one = df.agg(*(F.var_pop(present(df, c)).alias(c) for c in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in names))).alias("r")).select("r.*")


def f_classif(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """feature, f: analysis of variance of each feature over the classes, in one shuffle of class sums."""
    per = df.groupBy(label).agg(F.count("*").cast("double").alias("n"), *(F.struct(F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(c) for c in names))
    long = per.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}.m").alias("m"), F.col(f"{c}.v").alias("v")) for c in names))).alias("r")).select("n", "r.*")
    w = Window.partitionBy("feature")
    long = long.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = long.groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return s.select("feature", F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("f"))


def f_regression(df: DataFrame, names: list[str], target: str) -> DataFrame:
    """feature, f from the squared correlation."""
    one = df.agg(F.count("*").alias("n"), *(F.corr(c, target).alias(c) for c in names))
    long = one.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in names))).alias("x")).select("n", "x.*")
    return long.select("feature", F.try_divide(F.col("r") * F.col("r") * (F.col("n") - 2), 1 - F.col("r") * F.col("r")).alias("f"))


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("f"), "feature").limit(k)
