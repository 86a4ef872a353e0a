import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import neighbors, signal
from quarry.sources import io
from quarry.streaming import monitors


def _parts(spark, tmp_path, rows, schema, cut):
    """Rows as files that a stream reads one a trigger, in order."""
    for k in range(0, len(rows), cut):
        spark.createDataFrame(rows[k:k + cut], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return monitors.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)


def test_count_windows_over_chunks_equal_those_of_all(spark, tmp_path):
    rows = [(k, t, float(t * t % 17)) for t in range(23) for k in "ab"]
    stream = _parts(spark, tmp_path, rows, "k string, t int, v double", 14)
    got = {(r.k, r.number): r["mean"] for r in monitors.run_to_end(monitors.count_windows(stream, "k", "t", "v", 5, 2), "count_windows").collect()}
    v = [float(t * t % 17) for t in range(23)]
    assert got == {(k, n): pytest.approx(sum(v[2 * n:2 * n + 5]) / 5) for k in "ab" for n in range((23 - 5) // 2 + 1)}


def test_online_cusum_alarms_after_the_change(spark, tmp_path):
    rows = [("m", t, 0.0 if t < 20 else 3.0) for t in range(40)]
    stream = _parts(spark, tmp_path, rows, "k string, t int, v double", 9)
    places = sorted(r.place for r in monitors.run_to_end(monitors.online_cusum(stream, "k", "t", "v", 10, 5.0), "cusum_alarms").collect())
    assert places[0] == 21 and all(p >= 20 for p in places)


def test_late_labels_join(spark):
    p = spark.createDataFrame([("a", "2024-01-01 00:00:00", 0.5), ("b", "2024-01-01 00:00:00", 2.5)], "id string, ts string, score double").withColumn("ts", F.col("ts").cast("timestamp"))
    y = spark.createDataFrame([("a", "2024-01-01 05:00:00", 0), ("b", "2024-01-03 00:00:00", 1)], "id string, seen string, y int").withColumn("seen", F.col("seen").cast("timestamp"))
    assert [r.id for r in monitors.with_late_labels(p, y, "id", "ts", "seen").collect()] == ["a"]


def test_welch_finds_a_sine(spark):
    x = io.sine(spark, 1024, 128.0, 16.0).select(F.lit("s").alias("k"), "idx", "value")
    rows = signal.welch(x, "k", "idx", "value", 128.0, 128).orderBy(F.desc("power")).collect()
    assert rows[0].frequency == pytest.approx(16.0) and sum(r.power for r in rows) * 1.0 == pytest.approx(0.5, rel=1e-6)
    f = signal.spectral_features(x, "k", "idx", "value", 128.0, 128, 128).first()
    assert f.dominant == pytest.approx(16.0) and f.centroid == pytest.approx(16.0, abs=0.5)


def test_frames_are_full_and_overlap(spark):
    x = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "k string, i long, v double")
    got = {(r.frame, r.n) for r in signal.frames(x, "k", "i", 4, 3).groupBy("frame").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 4), (1, 4), (2, 4)}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n3,4\n")
    assert [(r.idx, r.channel, r.value) for r in io.load_text(spark, str(tmp_path / "a.csv")).orderBy("idx", "channel").collect()] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    np.save(tmp_path / "b.npy", np.arange(6.0).reshape(3, 2))
    assert [r.value for r in io.load_npy(spark, str(tmp_path / "b.npy")).orderBy("idx", "channel").collect()] == [0, 1, 2, 3, 4, 5]
    io.save_bundle(io.sine(spark, 8, 8.0, 1.0).withColumn("signal", F.lit("s")), {"rate": "8"}, str(tmp_path / "bundle"))
    rows, meta = io.load_bundle(spark, str(tmp_path / "bundle"))
    assert rows.count() == 8 and meta == {"rate": "8"}


def test_ols_and_kmeans(spark):
    rows = spark.createDataFrame([(0.0, 1.0, 1.0), (1.0, 2.0, 3.0), (2.0, 4.0, 6.0), (3.0, 7.0, 10.0)], "x0 double, x1 double, y double")
    a = np.array([[1, 0, 1], [1, 1, 2], [1, 2, 4], [1, 3, 7]], float)
    want = np.linalg.lstsq(a, np.array([1.0, 3, 6, 10]), rcond=None)[0]
    assert list(neighbors.ols(rows, ["x0", "x1"], "y").values()) == pytest.approx(list(want))
    points = spark.createDataFrame([(k, [s * 2.5 + k % 3 / 10, s * 2.3]) for k, s in enumerate([-1, -1, -1, 1, 1, 1])], "id long, v array<double>")
    starts = spark.createDataFrame([(0, [-1.0, -1.0]), (1, [1.0, 1.0])], "label long, centroid array<double>")
    found = {r.label: r.centroid for r in neighbors.kmeans(points, "id", "v", starts).collect()}
    assert found[0] == pytest.approx([-2.4, -2.3]) and found[1] == pytest.approx([2.6, 2.3])


def test_blobs_and_closed_forms(spark):
    rows = io.blobs(spark, 300, [[0.0, 0.0], [9.0, 9.0]], 0.5, 1).groupBy("label").agg(F.avg(F.col("x")[0]).alias("m")).orderBy("label").collect()
    assert [round(r.m) for r in rows] == [0, 9] and math.isfinite(rows[0].m)
