"""Exact quantiles without a table of the distinct values."""

import math

from pyspark.sql import functions as F

from quarry.functions import quantiles
from quarry.operators import preprocessing, quality, stats


def test_quantiles_equal_percentile(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    df = spark.range(3000).select(
        (F.xxhash64("id") % 1000 / 7.0).alias("a"), F.when(F.col("id") % 10 > 2, F.lit(4.0)).otherwise(F.col("id") * 1e290).alias("b"), F.lit(2.0).alias("c"),
        F.when(F.col("id") % 3 > 0, F.exp(F.col("id") / 50.0)).otherwise(F.lit(float("-inf"))).alias("d"), F.when(F.col("id") % 4 == 1, F.col("id")).alias("e"), F.lit(None).cast("double").alias("f"))
    shares = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    want = df.agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in df.columns)).first().asDict()
    got = quantiles.exact_quantiles(df, {c: (F.col(c), shares) for c in df.columns})
    assert {c: got[c] if got[c][0] is not None else None for c in want} == want
    odd = spark.createDataFrame([(x,) for x in (1.0, math.nan, 3.0, math.nan)], "v double")
    a, b = quantiles.exact_quantiles(odd, {"v": (F.col("v"), [1 / 3, 1.0])})["v"]
    assert a == 3.0 and math.isnan(b)


def test_no_aggregate_holds_all_values(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("v"))
    made = [stats.outliers(df, "v", "iqr"), stats.outliers(df, "v", "mod_zscore"), preprocessing.robust_scale(df, ["v"]), preprocessing.discretize(df, "v", 4), preprocessing.impute(df, ["v"], "median"), quality.numeric_profile(df, ["v"])]
    assert all("percentile(" not in x._jdf.queryExecution().analyzed().toString() for x in made)
