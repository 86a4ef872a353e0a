"""Ranks with ties averaged, from counts of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds the average rank of value, from 1, within by.

    Ranks are made on one row a distinct value and joined back, so ties and repeated
    rows are aggregated before the sort.
    """
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(value) if by else Window.orderBy(value)
    ranks = counts.withColumn(name, F.sum("_n").over(w) - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(ranks, [*by, value])
