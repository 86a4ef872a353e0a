"""Drift between two tables: stability index of numbers, variation distance of categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.missing import is_numeric, present


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Number from 0 of the equal-width bin from low to high; the last is closed, null
    beyond. Where low is high, the range is widened by a half on both sides."""
    lo, hi = F.when(low == high, low - 0.5).otherwise(low), F.when(low == high, high + 0.5).otherwise(high)
    place = F.floor((value - lo) / (hi - lo) * bins)
    return F.when((value >= lo) & (value <= hi), F.least(place, F.lit(bins - 1))).cast("int")


def numeric_drift(train: DataFrame, test: DataFrame, name: str, bins: int = 10) -> DataFrame:
    """One row: differences of missing share, mean and deviation, and the stability index.

    Bins come from the train range; test values beyond it are in none. Counts of both
    sides start at one.
    """
    t, s = train.select(present(train, name).alias("v")), test.select(present(test, name).alias("v"))
    edges = t.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))

    def counted(x: DataFrame, side: str) -> DataFrame:
        binned = x.filter(F.col("v").isNotNull()).crossJoin(F.broadcast(edges)).select(bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        return binned.filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias(side))

    every = train.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    both = every.join(counted(t, "p"), "bin", "left").join(counted(s, "q"), "bin", "left").select((F.coalesce("p", F.lit(0)) + 1.0).alias("p"), (F.coalesce("q", F.lit(0)) + 1.0).alias("q"))
    totals = both.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    p, q = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    psi = both.crossJoin(F.broadcast(totals)).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    side = lambda x, k: x.agg(F.try_divide(F.count_if(F.col("v").isNull()), F.count("*")).alias(f"miss{k}"), F.avg("v").alias(f"mean{k}"), F.stddev_pop("v").alias(f"std{k}"))
    return side(t, 0).crossJoin(side(s, 1)).crossJoin(psi).select(
        F.lit(name).alias("column"), F.lit("numeric").alias("kind"), (F.col("miss1") - F.col("miss0")).alias("missing_diff"), (F.col("mean1") - F.col("mean0")).alias("mean_diff"), (F.col("std1") - F.col("std0")).alias("std_diff"),
        "psi", F.lit(None).cast("double").alias("tvd"), F.lit(None).cast("double").alias("unseen_rate"))


def categorical_drift(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """One row: difference of missing share, total variation distance, share of unseen values."""
    count = lambda x, k: x.select(present(x, name).cast("string").alias("v")).groupBy("v").agg(F.count("*").alias(k))
    both = count(train, "p").join(count(test, "q"), "v", "full_outer").select("v", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    have = F.col("v").isNotNull()
    sums = both.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"), F.sum(F.when(have, F.col("p"))).alias("sp"), F.sum(F.when(have, F.col("q"))).alias("sq"))
    joined = both.crossJoin(F.broadcast(sums))
    return joined.agg(
        (F.sum(F.when(~have, F.try_divide("q", "nq")).otherwise(0.0)) - F.sum(F.when(~have, F.try_divide("p", "np")).otherwise(0.0))).alias("missing_diff"),
        (0.5 * F.sum(F.when(have, F.abs(F.try_divide("p", "sp") - F.try_divide("q", "sq"))))).alias("tvd"),
        F.try_divide(F.sum(F.when(have & (F.col("p") == 0), F.col("q"))), F.max("sq")).alias("u"),
    ).select(F.lit(name).alias("column"), F.lit("categorical").alias("kind"), "missing_diff", F.lit(None).cast("double").alias("mean_diff"), F.lit(None).cast("double").alias("std_diff"), F.lit(None).cast("double").alias("psi"), "tvd", F.coalesce("u", F.lit(0.0)).alias("unseen_rate"))


def drift_report(train: DataFrame, test: DataFrame, bins: int = 10) -> DataFrame:
    """A row for each column of both tables."""
    parts = [numeric_drift(train, test, c, bins) if is_numeric(train, c) and is_numeric(test, c) else categorical_drift(train, test, c) for c in train.columns if c in test.columns]
    if not parts:
        raise ValueError("the tables share no column")
    return reduce(DataFrame.unionByName, parts)
