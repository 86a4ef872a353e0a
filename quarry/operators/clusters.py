"""Clusterings of numeric columns: quality indices, a grid join within a radius, and
density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.state import checkpointed
from quarry.operators.graph import connected_components


def _centres(df: DataFrame, label: str, names: list[str]) -> DataFrame:
    return df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"_m_{c}") for c in names))


def calinski_harabasz(df: DataFrame, label: str, names: list[str]) -> DataFrame:
    """Between over within variance; one aggregate of class means and variances."""
    per = df.groupBy(label).agg(F.count("*").cast("double").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in names), *(F.var_pop(c).alias(f"v_{c}") for c in names))
    w = Window.partitionBy(F.lit(1))
    for c in names:
        per = per.withColumn(f"g_{c}", F.sum(F.col("n") * F.col(f"m_{c}")).over(w) / F.sum("n").over(w))
    between = sum((F.col("n") * F.pow(F.col(f"m_{c}") - F.col(f"g_{c}"), 2) for c in names), F.lit(0.0))
    within = sum((F.col("n") * F.col(f"v_{c}") for c in names), F.lit(0.0))
    s = per.agg(F.sum(between).alias("b"), F.sum(within).alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return s.select(F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1)).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, label: str, names: list[str]) -> DataFrame:
    """Mean over classes of the worst ratio of spreads to the distance of centres.

    Centres, one row a class, are broadcast and joined with each other only.
    """
    centres = _centres(df, label, names)
    away = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_m_{c}"), 2) for c in names), F.lit(0.0)))
    spread = df.join(F.broadcast(centres), F.col(label) == F.col("_label")).groupBy("_label").agg(F.avg(away).alias("_s"), *(F.first(f"_m_{c}").alias(f"_m_{c}") for c in names))
    other = spread.select(F.col("_label").alias("o"), F.col("_s").alias("os"), *(F.col(f"_m_{c}").alias(f"o_{c}") for c in names))
    gap = F.sqrt(sum((F.pow(F.col(f"_m_{c}") - F.col(f"o_{c}"), 2) for c in names), F.lit(0.0)))
    worst = spread.join(F.broadcast(other), F.col("_label") != F.col("o")).groupBy("_label").agg(F.max(F.try_divide(F.col("_s") + F.col("os"), gap)).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def within_radius(df: DataFrame, id_col: str, x: str, y: str, radius: float) -> DataFrame:
    """a, b, distance of all pairs a < b not further apart than radius.

    Points meet in the cells of a grid of that side: a point goes to its own cell, and
    the other side to the nine around, so the join is on equal cells. Both sides are
    shuffled: a join that broadcasts one would hold all points on the driver.
    """
    p = df.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    cell = lambda c: F.floor(F.col(c) / radius)
    left = p.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("i"), cell("y").alias("j"))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    right = p.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), steps.alias("s")).select("b", "bx", "by", (cell("bx") + F.col("s.di")).alias("i"), (cell("by") + F.col("s.dj")).alias("j"))
    distance = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return left.hint("merge").join(right, ["i", "j"]).filter(F.col("a") < F.col("b")).select("a", "b", distance.alias("distance")).filter(F.col("distance") <= radius)


def dbscan(df: DataFrame, id_col: str, x: str, y: str, radius: float, least: int) -> DataFrame:
    """id, cluster: the least core id of the cluster, null for noise.

    A core has least points within radius, itself included; cores within radius share a
    cluster, and another point joins that of its least core neighbour's cluster.
    """
    # points at one place share their neighbours, so places are paired, with their counts and least ids
    here = [F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")]
    places = checkpointed(df.select(*here).dropna(subset=["x", "y"]).groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    pairs = within_radius(places, "id", "x", "y", radius)
    both = checkpointed(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    around = both.join(places.select(F.col("id").alias("b"), "n").hint("shuffle_hash"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("around"))
    cores = checkpointed(places.join(around, "id", "left").filter(F.coalesce("around", F.lit(0)) + F.col("n") >= least).select("id"))
    core_edges = both.join(cores.withColumnRenamed("id", "a"), "a", "left_semi").join(cores.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    joined = checkpointed(cores.join(connected_components(core_edges), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster")))
    border = both.join(joined.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
    found = places.join(joined, "id", "left").join(border, "id", "left").select("x", "y", F.coalesce("cluster", "near").alias("cluster"))
    return df.select(*here).join(found.hint("shuffle_hash"), ["x", "y"], "left").select("id", "cluster")
