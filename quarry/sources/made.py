"""Made tables for tests and demonstrations. Every number hangs on the row's id and the seed, so any partitioning gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.distributions import Normal, unit_draw


def blobs(spark: SparkSession, n: int, centres: list[list[float]], deviation: float = 1.0, seed: int = 0) -> DataFrame:
    """id, x (array), label: points around centres, in turn."""
    rows = spark.range(n).withColumn("label", (F.col("id") % len(centres)).cast("int"))
    middle = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in centres))
    return rows.select("id", F.array(*(F.get(F.get(middle, "label"), F.lit(k)) + Normal(0.0, deviation).draw("id", seed * 1000 + k) for k in range(len(centres[0])))).alias("x"), "label")


def moons(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """id, x, label: two half circles, one into the other."""
    t = F.floor(F.col("id") / 2) / max(1, (n + 1) // 2 - 1) * math.pi
    rows = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int"))
    upper = F.col("label") == 0
    a = F.when(upper, F.cos(t)).otherwise(1 - F.cos(t)) + Normal(0.0, 1.0).draw("id", seed) * noise
    b = F.when(upper, F.sin(t)).otherwise(0.5 - F.sin(t)) + Normal(0.0, 1.0).draw("id", seed + 1) * noise
    return rows.select("id", F.array(a, b).alias("x"), "label")


def classification(spark: SparkSession, n: int, features: int = 20, informative: int = 5, classes: int = 2, gap: float = 1.5, seed: int = 0) -> DataFrame:
    """id, x, label: the first features' means differ by class, the others are noise."""
    rows = spark.range(n).withColumn("label", (F.col("id") % classes).cast("int"))
    sign = lambda k: F.when(F.pmod(F.xxhash64("label", F.lit(k), F.lit(seed)), F.lit(2)) == 0, gap).otherwise(-gap)
    return rows.select("id", F.array(*(Normal().draw("id", seed * 1000 + k) + (sign(k) if k < informative else F.lit(0.0)) for k in range(features))).alias("x"), "label")


def regression(spark: SparkSession, n: int, coefficients: list[float], noise: float = 0.0, seed: int = 0) -> DataFrame:
    """id, x, y: a straight sum of normal features and noise."""
    x = [Normal().draw("id", seed * 1000 + k) for k in range(len(coefficients))]
    y = sum((F.lit(float(c)) * v for c, v in zip(coefficients, x)), F.lit(0.0)) + noise * Normal().draw("id", seed * 1000 + 999)
    return spark.range(n).select("id", F.array(*x).alias("x"), y.alias("y"))


def anomaly_series(spark: SparkSession, n: int = 4000, change: int = 2000, before: float = 180.0, after: float = 260.0, rate: float = 16000.0, shift: float = 0.5, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """i, v, changed: a tone whose frequency and mean change at a point."""
    late = F.col("id") >= change
    tone = F.sin(2 * math.pi * F.when(late, after).otherwise(before) * F.col("id") / rate)
    return spark.range(n).select(F.col("id").alias("i"), (tone + F.when(late, shift).otherwise(0.0) + noise * (2 * unit_draw("id", seed) - 1)).alias("v"), late.alias("changed"))
