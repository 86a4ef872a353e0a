"""Structured Streaming: windows by event time, count windows, online change detection,
and labels that come late. Each takes and returns a streaming (or batch) DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, by: str, value: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """by, start, n, total of event-time windows; state of windows older than late is dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(by, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(by, F.col("w.start").alias("start"), "n", "total")


def count_windows(events: DataFrame, by: str, order: str, value: str, size: int, hop: int) -> DataFrame:
    """by, number, n, mean of sliding windows of size rows, one each hop rows.

    State is the last rows of a key that a later window still needs, at most size + hop.
    Rows of one trigger are taken in the given order.
    """

    def step(key, batches: Iterator, state):
        import pandas as pd

        held, number = state.get if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(order)
        held, out = [*held, *map(float, rows[value])], []
        while len(held) >= size:
            out.append((key[0], number, size, sum(held[:size]) / size))
            held, number = held[hop:], number + 1
        state.update((held, number))
        yield pd.DataFrame(out, columns=[by, "number", "n", "mean"])

    kind = events.schema[by].dataType.simpleString()
    return events.select(by, order, value).groupBy(by).applyInPandasWithState(step, f"{by} {kind}, number long, n long, mean double", "held array<double>, number long", "append", "NoTimeout")


def online_cusum(events: DataFrame, by: str, order: str, value: str, baseline: int, threshold: float, drift: float = 0.0) -> DataFrame:
    """by, place (number of the row in its key) of alarms: the first baseline rows give the
    mean; then a sum of deviations on either side that reaches the threshold alarms and starts anew."""

    def step(key, batches: Iterator, state):
        import pandas as pd

        n, total, up, down = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        out = []
        for x in map(float, pd.concat(list(batches)).sort_values(order)[value]):
            n += 1
            if n <= baseline:
                total += x
                continue
            d = x - total / baseline
            up, down = max(0.0, up + d - drift), max(0.0, down - d - drift)
            if max(up, down) >= threshold:
                out.append((key[0], n - 1))
                up = down = 0.0
        state.update((n, total, up, down))
        yield pd.DataFrame(out, columns=[by, "place"])

    kind = events.schema[by].dataType.simpleString()
    return events.select(by, order, value).groupBy(by).applyInPandasWithState(step, f"{by} {kind}, place long", "n long, total double, up double, down double", "append", "NoTimeout")


def with_late_labels(scored: DataFrame, labels: DataFrame, id_col: str, ts: str, label_ts: str, wait: str = "1 day") -> DataFrame:
    """Predictions joined with labels that come up to wait later; both need event times."""
    left, right = scored.withWatermark(ts, wait).alias("p"), labels.withWatermark(label_ts, wait).alias("l")
    near = (F.col(f"p.{id_col}") == F.col(f"l.{id_col}")) & F.expr(f"l.{label_ts} >= p.{ts} AND l.{label_ts} <= p.{ts} + INTERVAL {wait}")
    return left.join(right, near).select("p.*", *(F.col(f"l.{c}") for c in labels.columns if c not in (id_col, *scored.columns)))


def file_stream(spark: SparkSession, path: str, schema, pattern: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All results of a bounded stream, through a memory sink; for tests and small tables."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
