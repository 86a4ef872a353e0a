"""Entropies and partition comparisons from joint counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _h(n: Column, total: Column) -> Column:
    """Entropy in nats of counts that share a total."""
    return F.sum(-(n / total) * F.ln(n / total))


def joint(df: DataFrame, x: str, y: str) -> DataFrame:
    """Entropies of x, y and both from one pass of grouping sets: hx, hy, hxy."""
    sets = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna().groupingSets([["x"], ["y"], ["x", "y"]], "x", "y").agg(F.grouping_id().alias("g"), F.count("*").cast("double").alias("n"))
    sets = sets.withColumn("t", F.sum("n").over(Window.partitionBy("g")))
    part = -(F.col("n") / F.col("t")) * F.ln(F.col("n") / F.col("t"))
    # grouping ids: 1 keeps x, 2 keeps y, 0 both
    return sets.agg(*(F.sum(F.when(F.col("g") == g, part).otherwise(0.0)).alias(c) for g, c in ((1, "hx"), (2, "hy"), (0, "hxy"))))


def mutual_information(df: DataFrame, x: str, y: str, base: float = math.e) -> DataFrame:
    """Entropies, conditional entropy, mutual information, its forms normalised by the
    root, mean, max and min of the entropies, and the variation of information."""
    k = F.lit(1.0 / math.log(base))
    hx, hy, hxy = F.col("hx"), F.col("hy"), F.col("hxy")
    mi = hx + hy - hxy
    safe = lambda d: F.when(d > 0, F.try_divide(mi, d)).otherwise(0.0)
    return joint(df, x, y).select(
        (hx * k).alias("entropy_x"), (hy * k).alias("entropy_y"), (hxy * k).alias("joint_entropy"), ((hxy - hy) * k).alias("conditional_entropy"), (mi * k).alias("mutual_information"),
        safe(F.sqrt(hx * hy)).alias("nmi_sqrt"), safe((hx + hy) / 2).alias("nmi_arithmetic"), safe(F.greatest(hx, hy)).alias("nmi_max"), safe(F.least(hx, hy)).alias("nmi_min"), ((2 * hxy - hx - hy) * k).alias("variation_of_information"))


def divergences(left: DataFrame, right: DataFrame, value: str, floor: float = 1e-12) -> DataFrame:
    """cross_entropy, kl and js (in nats) of the distributions of a value in two tables."""
    count = lambda d, c: d.select(value).dropna().groupBy(value).agg(F.count("*").cast("double").alias(c))
    both = count(left, "p").join(count(right, "q"), value, "full_outer").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    w = Window.partitionBy(F.lit(1))
    both = both.select((F.col("p") / F.sum("p").over(w)).alias("p"), (F.col("q") / F.sum("q").over(w)).alias("q"))
    p, q, m = F.col("p"), F.col("q"), (F.col("p") + F.col("q")) / 2
    q_safe = F.greatest(q, F.lit(floor))
    kl = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)
    return both.agg(F.sum(-p * F.ln(q_safe)).alias("cross_entropy"), F.sum(kl(p, q_safe)).alias("kl"), (0.5 * F.sum(kl(p, m)) + 0.5 * F.sum(kl(q, m))).alias("js"))


def partitions(df: DataFrame, a: str, b: str) -> DataFrame:
    """adjusted_rand, homogeneity, completeness and v_measure of two labellings."""
    counts = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupingSets([["a"], ["b"], ["a", "b"]], "a", "b").agg(F.grouping_id().alias("g"), F.count("*").cast("double").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    s = counts.agg(*(F.sum(F.when(F.col("g") == g, pairs).otherwise(0.0)).alias(c) for g, c in ((1, "pa"), (2, "pb"), (0, "pab"))), F.sum(F.when(F.col("g") == 1, F.col("n")).otherwise(0.0)).alias("n"))
    every = F.col("n") * (F.col("n") - 1) / 2
    chance = F.try_divide(F.col("pa") * F.col("pb"), every)
    rand = F.coalesce(F.try_divide(F.col("pab") - chance, (F.col("pa") + F.col("pb")) / 2 - chance), F.lit(1.0))
    mi = F.col("hx") + F.col("hy") - F.col("hxy")
    hom, com = F.when(F.col("hx") > 0, F.try_divide(mi, F.col("hx"))).otherwise(1.0), F.when(F.col("hy") > 0, F.try_divide(mi, F.col("hy"))).otherwise(1.0)
    rows = s.crossJoin(joint(df, a, b)).select(rand.alias("adjusted_rand"), hom.alias("homogeneity"), com.alias("completeness"))
    return rows.withColumn("v_measure", F.coalesce(F.try_divide(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")), F.lit(0.0)))
