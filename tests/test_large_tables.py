"""What only shows in large or odd tables: sums beyond a long, series in one task, repeated places."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import clusters, learners, stats, timeseries


def test_wilcoxon_of_more_rows_than_a_cube_in_a_long_allows(spark):
    n = 1_800_000
    got = stats.wilcoxon(spark.range(n).select(F.when(F.col("id") % 3 == 0, 2.0).otherwise(0.0).alias("x"), F.lit(1.0).alias("y")), "x", "y").first()
    assert got["n"] == n and got["w"] == n / 3 * (n + 1) / 2
    assert abs(got["z"] - (got["w"] - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)) < 1e-6


def _interpolated(samples, rate, max_gap):
    low, high = max(min(t for t, _ in s) for s in samples.values()), min(max(t for t, _ in s) for s in samples.values())
    out = {}
    for c, s in samples.items():
        for k in range(int((high - low) * rate + 1e-9) + 1):
            t = low + k / rate
            before, after = max(p for p in s if p[0] <= t), min((p for p in s if p[0] >= t), default=None)
            value = None
            if after is not None and after[0] - before[0] <= max_gap:
                value = before[1] if after[0] == before[0] else before[1] + (after[1] - before[1]) * ((t - before[0]) / (after[0] - before[0]))
            out[c, t] = value
    return out


def test_aligned_equals_interpolation_between_samples(spark):
    r = np.random.default_rng(3)
    samples = {c: [(float(t), float(v)) for t, v in zip(np.sort(r.uniform(0, 9, n)).round(1), r.normal(size=n))] for c, n in (("a", 90), ("b", 12), ("c", 40))}
    df = spark.createDataFrame([(c, t, v) for c, s in samples.items() for t, v in s], "c string, t double, v double")
    got = {(x["c"], x["t"]): x["value"] for x in timeseries.aligned(df, "c", "t", "v", 10.0, 1.5).collect()}
    want = _interpolated(samples, 10.0, 1.5)
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == want[k] if want[k] is None or got[k] is None else abs(got[k] - want[k]) < 1e-9 for k in want)


def test_aligned_channels_that_do_not_overlap_have_no_grid(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 1.0), ("b", 5.0, 1.0), ("b", 6.0, 1.0)], "c string, t double, v double")
    assert timeseries.aligned(df, "c", "t", "v", 1.0, 9.0).count() == 0


def test_aligned_takes_time_in_proportion_to_a_channel(spark):
    df = spark.range(400_000).select(F.lit("a").alias("c"), (F.col("id") / 1000.0).alias("t"), F.col("id").cast("double").alias("v"))
    start = time.time()
    assert timeseries.aligned(df, "c", "t", "v", 100.0, 1.0).count() == 40_000
    assert time.time() - start < 30


def test_clusters_of_repeated_places_pair_places_only(spark):
    r = np.random.default_rng(5)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.integers(0, 12, (120, 2)) * 0.7)]
    points += [(1000 + i, 99.0, 99.0) for i in range(3)] + [(2000 + i, 50.0, 50.0) for i in range(4)] + [(3000, None, 1.0)]
    near = {i: [j for j, c, d in points if c is not None and a is not None and math.sqrt((a - c) ** 2 + (b - d) ** 2) <= 0.9] for i, a, b in points}
    core, label = {i for i in near if len(near[i]) >= 4}, {}
    for i in sorted(core):
        todo = [] if i in label else [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += [y for y in near[x] if y in core]
    want = {i: label.get(i, min((label[j] for j in near[i] if j in core), default=None)) for i in near}
    df = spark.createDataFrame(points, "id long, x double, y double")
    assert {x["id"]: x["cluster"] for x in clusters.dbscan(df, "id", "x", "y", 0.9, 4).collect()} == want
    # 200,000 points at 100 places: all pairs of points would be 200 million
    many = spark.range(200_000).select("id", (F.col("id") % 100).cast("double").alias("x"), F.lit(0.0).alias("y"))
    start = time.time()
    assert [tuple(x) for x in clusters.dbscan(many, "id", "x", "y", 0.5, 4).groupBy("cluster").count().filter("count = 2000").groupBy("count").count().collect()] == [(2000, 100)]
    assert time.time() - start < 60


def test_no_side_of_the_radius_join_is_broadcast(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    plan = clusters.within_radius(df, "id", "x", "y", 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_kalman_gives_python_batches_not_series(spark):
    rows = [("a", i, float(np.sin(i))) for i in range(25_000)] + [("b", i, float(i)) for i in range(3)] + [(None, 0, 7.0)]
    got = learners.kalman(spark.createDataFrame(rows, "k string, i long, v double").repartition(5), "k", "i", "v")
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r["k"], r["i"]): (r["estimate"], r["variance"]) for r in got.collect()}
    want, m, p = {}, None, None
    for n, (k, i, v) in enumerate(rows):
        if i == 0:
            m, p = v, 1.0
        else:
            p += 1e-2
            g = p / (p + 1.0)
            m, p = m + g * (v - m), (1 - g) * p
        want[k, i] = (m, p)
    assert found == want
