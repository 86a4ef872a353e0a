"""Correlations, rank tests, contingency and analysis of variance, and outliers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.quantiles import as_literals, exact_quantiles
from quarry.functions.ranks import average_ranks


def normal_cdf(z: Column) -> Column:
    """Of the standard normal, by a series and a continued fraction in native arithmetic.

    Within 1e-12 or so: below 3 the Taylor series of the error function, above it the
    Laplace fraction of its complement, 60 terms each.
    """
    x = F.abs(z) / math.sqrt(2)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("t"), x.alias("s")), lambda a, n: F.struct((a["t"] * x * x * 2 / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * x * x * 2 / (2 * n + 1)).alias("s")), lambda a: a["s"])
    series = 1 - terms * F.exp(-x * x) * (2 / math.sqrt(math.pi))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda a, n: x + n / 2.0 / a)
    far = F.exp(-x * x) / math.sqrt(math.pi) / fraction
    tail = F.when(x < 3, series).otherwise(far) / 2
    return F.when(z > 0, 1 - tail).otherwise(tail)


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """pearson and spearman (of average ranks); 0 where a side is constant."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    ranked = average_ranks(average_ranks(rows, "x", name="rx"), "y", name="ry")
    return ranked.agg(F.coalesce(F.corr("x", "y"), F.lit(0.0)).alias("pearson"), F.coalesce(F.corr("rx", "ry"), F.lit(0.0)).alias("spearman"))


def mann_whitney(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """u of the first group, z and the two-sided p of the normal approximation with ties."""
    rows = df.filter(F.col(group).isin(first, second)).select(F.col(value).alias("v"), F.col(group).alias("g")).dropna()
    counts = rows.groupBy("v").agg(F.count_if(F.col("g") == first).alias("a"), F.count("*").alias("t"))
    ranks = counts.withColumn("rank", F.sum("t").over(Window.orderBy("v")) - (F.col("t") - 1) / 2.0)
    s = ranks.agg(F.sum(F.col("rank") * F.col("a")).alias("r"), F.sum("a").cast("double").alias("n1"), F.sum(F.col("t") - F.col("a")).cast("double").alias("n2"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u1 = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    s = s.withColumn("u", F.least(u1, F.col("n1") * F.col("n2") - u1))
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    s = s.withColumn("z", F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2, sd))
    return s.select("u", "z", F.least(F.lit(1.0), 2 * normal_cdf(-F.abs("z"))).alias("p"))


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """w (the smaller signed rank sum), n of non-zero differences, and z."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).dropna().filter("d <> 0").withColumn("v", F.abs("d"))
    counts = d.groupBy("v").agg(F.count_if(F.col("d") > 0).alias("a"), F.count("*").alias("t"))
    ranks = counts.withColumn("rank", F.sum("t").over(Window.orderBy("v")) - (F.col("t") - 1) / 2.0)
    s = ranks.agg(F.sum(F.col("rank") * F.col("a")).alias("plus"), F.sum(F.col("rank") * (F.col("t") - F.col("a"))).alias("minus"), F.sum("t").alias("n"))
    # the cube of n is beyond a long from 1.7 million rows on
    w, n = F.least("plus", "minus"), F.col("n").cast("double")
    return s.select(w.alias("w"), "n", F.try_divide(w - n * (n + 1) / 4.0, F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)).alias("z"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """h, corrected for ties, and its degrees of freedom."""
    rows = df.select(F.col(value).alias("v"), F.col(group).alias("g")).dropna()
    ties = rows.groupBy("v").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    per = average_ranks(rows, "v").groupBy("g").agg(F.sum("rank").alias("r"), F.count("*").cast("double").alias("n"))
    s = per.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("rr"), F.sum("n").alias("n"), (F.count("*") - 1).alias("df")).crossJoin(ties)
    n = F.col("n")
    h = 12 / (n * (n + 1)) * F.col("rr") - 3 * (n + 1)
    return s.select((h / (1 - F.col("ties") / (n * n * n - n))).alias("h"), "df")


def chi2_contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 and degrees of freedom of two categorical columns: cells that don't occur enter through the margins."""
    counts = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    cells = counts.withColumn("r", F.sum("n").over(Window.partitionBy("a"))).withColumn("c", F.sum("n").over(Window.partitionBy("b")))
    # sum (o - e)^2 / e = n * (sum o^2 / (r c) - 1)
    return cells.agg((F.sum("n") * (F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))) - 1)).alias("chi2"), ((F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)).alias("df"))


def f_oneway(df: DataFrame, value: str, group: str) -> DataFrame:
    """f and degrees of freedom of a one-way analysis of variance."""
    rows = df.select(F.col(value).cast("double").alias("v"), F.col(group).alias("g")).dropna()
    per = rows.groupBy("g").agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    per = per.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(F.lit(1))) / F.sum("n").over(Window.partitionBy(F.lit(1))))
    s = per.agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return s.select(F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).cast("long").alias("df_within"))


def outliers(df: DataFrame, value: str, method: str = "iqr", limit: float | None = None) -> DataFrame:
    """Rows whose value is an outlier, by "zscore", "mod_zscore" or "iqr"; score is added.

    Bounds are numbers; rows aren't shuffled.
    """
    v = F.col(value).cast("double")
    if method == "zscore":
        b = df.agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
        return df.crossJoin(F.broadcast(b)).withColumn("score", F.abs(v - F.col("_m")) / F.greatest("_s", F.lit(1e-12))).drop("_m", "_s").filter(F.col("score") > (limit or 3.0))
    if method == "mod_zscore":
        m = as_literals(exact_quantiles(df, {"v": (v, [0.5])})["v"])[0]
        mad = as_literals(exact_quantiles(df, {"v": (F.abs(v - m), [0.5])})["v"])[0]
        return df.withColumn("score", 0.6745 * F.abs(v - m) / F.greatest(mad, F.lit(1e-12))).filter(F.col("score") > (limit or 3.5))
    q = as_literals(exact_quantiles(df, {"v": (v, [0.25, 0.75])})["v"])
    k, lo, hi = limit or 1.5, q[0], q[1]
    out = df.withColumn("score", F.greatest(lo - v, v - hi))
    return out.filter((v < lo - k * (hi - lo)) | (v > hi + k * (hi - lo)))


def ks_normal(df: DataFrame, value: str, mean: float, std: float) -> DataFrame:
    """Largest distance of the normal distribution from the mid-point empirical one, (i - 0.5) / n."""
    counts = df.select(F.col(value).cast("double").alias("v")).dropna().groupBy("v").agg(F.count("*").alias("t"))
    n = F.sum("t").over(Window.partitionBy(F.lit(1)))
    ends = counts.select("v", "t", F.sum("t").over(Window.orderBy("v")).alias("e"), n.alias("n"))
    cdf = normal_cdf((F.col("v") - mean) / std)
    return ends.agg(F.max(F.greatest(F.abs(cdf - (F.col("e") - 0.5) / F.col("n")), F.abs(cdf - (F.col("e") - F.col("t") + 0.5) / F.col("n")))).alias("d"))
