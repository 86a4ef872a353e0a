"""Queries on signals and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import signal
from quarry.plans.common import rounded, table
from quarry.streaming import monitors


def _wave(spark, d):
    """Each event type's values in order of time, as a signal around its mean."""
    w = Window.partitionBy("event_type").orderBy("event_id")
    return table(spark, d, "events").select("event_type", (F.row_number().over(w) - 1).cast("long").alias("i"), (F.col("value") - 50.0).alias("v"))


K = ("event_type", "i", "v")


def q(f, digits=6):
    return lambda spark, d: rounded(f(_wave(spark, d)), digits)


def stream_windows(spark, d):
    schema = table(spark, d, "events").schema
    events = monitors.file_stream(spark, d, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = monitors.windowed(events, "ts", "event_type", "value", "1 day")
    rows = monitors.run_to_end(out, f"windows_{uuid.uuid4().hex}", "complete")
    return rounded(rows.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "total"), 4)


QUERIES = {
    "frame_features": q(lambda x: signal.frame_features(x, *K, length=64, hop=32), 9),
    "local_peaks": q(lambda x: signal.local_peaks(x, *K, height=45.0).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("v").alias("total")), 4),
    "fir_filter": q(lambda x: signal.moving_filter(x, *K, taps=[0.5, 0.3, 0.2])),
    "spectral_features": q(lambda x: signal.spectral_features(x, *K, rate=100.0, length=64, hop=64)),
    "welch": q(lambda x: signal.welch(x, *K, rate=100.0, length=64)),
    "stream_windows": stream_windows,
}
_S = "s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value - 50.0 AS v FROM events)"
_W = "PARTITION BY event_type ORDER BY i"
ORACLES = {
    "frame_features": f"""WITH {_S}, c AS (SELECT *, lag(v) OVER ({_W}) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM s), f AS (SELECT event_type, k AS frame, v, CASE WHEN i > k * 32 AND sign(v) * sign(p) < 0 THEN 1 ELSE 0 END AS z FROM c JOIN range(10000) t(k) ON i >= k * 32 AND i < k * 32 + 64 AND k * 32 + 64 <= n),
 m AS (SELECT *, avg(v) OVER (PARTITION BY event_type, frame) AS a FROM f)
 SELECT event_type, frame, round(avg(v), 9) AS mean, round(sqrt(avg(v * v)), 9) AS rms, round(max(abs(v)), 9) AS peak, round(avg((v - a) ^ 4) / avg((v - a) ^ 2) ^ 2, 9) AS kurtosis, CAST(sum(z) AS BIGINT) AS crossings, round(max(abs(v)) / sqrt(avg(v * v)), 9) AS crest FROM m GROUP BY 1, 2""",
    "local_peaks": f"WITH {_S}, c AS (SELECT *, lag(v) OVER ({_W}) AS a, lead(v) OVER ({_W}) AS b FROM s) SELECT event_type, count(*) AS n, round(sum(v), 4) AS total FROM c WHERE v > a AND v > b AND v >= 45 GROUP BY 1",
    "fir_filter": f"WITH {_S} SELECT event_type, i, round(0.5 * v + 0.3 * coalesce(lag(v, 1) OVER ({_W}), 0) + 0.2 * coalesce(lag(v, 2) OVER ({_W}), 0), 6) AS filtered FROM s",
    "stream_windows": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
