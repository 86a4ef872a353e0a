"""Signals: frames and their features. Rows are (signal, idx, value); a frame is a group
of rows by number, so long signals are processed in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frames(df: DataFrame, key: str, idx: str, length: int, hop: int) -> DataFrame:
    """Rows with frame: each once for every full frame it is in; idx counts from 0."""
    n = df.groupBy(key).agg((F.max(idx) + 1).alias("_n"))
    rows = df.join(F.broadcast(n), key)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(idx) - length + 1) / hop))
    last = F.least(F.floor(F.col(idx) / hop), F.floor((F.col("_n") - length) / hop))
    return rows.filter(F.col("_n") >= length).withColumn("_f", F.when(last >= first, F.sequence(first, last))).drop("_n").withColumn("frame", F.explode("_f")).drop("_f")


def frame_features(df: DataFrame, key: str, idx: str, value: str, length: int, hop: int) -> DataFrame:
    """key, frame, mean, rms, peak, crest, kurtosis (not excess) and zero crossings."""
    w = Window.partitionBy(key).orderBy(idx)
    signed = df.withColumn("_c", ((F.signum(value) * F.signum(F.lag(value).over(w))) < 0).cast("int"))
    rows = frames(signed, key, idx, length, hop)
    out = rows.groupBy(key, "frame").agg(
        F.avg(value).alias("mean"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(F.abs(value)).alias("peak"), (F.kurtosis(value) + 3.0).alias("kurtosis"),
        F.sum(F.when(F.col(idx) > F.col("frame") * hop, F.coalesce("_c", F.lit(0))).otherwise(0)).alias("crossings"))
    return out.withColumn("crest", F.coalesce(F.try_divide("peak", "rms"), F.lit(0.0)))


def local_peaks(df: DataFrame, key: str, idx: str, value: str, height: float) -> DataFrame:
    """Rows above both neighbours and at least as high as height."""
    w = Window.partitionBy(key).orderBy(idx)
    return df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).filter((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) >= height)).drop("_a", "_b")


def _per_frame(df: DataFrame, key: str, idx: str, value: str, length: int, hop: int, schema: str, f) -> DataFrame:
    """f of a matrix of frames (rows), for Arrow batches of frames gathered as arrays."""
    rows = frames(df, key, idx, length, hop).groupBy(key, "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("x"))

    def run(batches: Iterator):
        import pandas as pd

        for batch in batches:
            if len(batch):
                yield pd.concat([batch[[key, "frame"]].reset_index(drop=True), f(np.stack(batch["x"].to_numpy()))], axis=1)

    return rows.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, frame long, {schema}")


def spectral_features(df: DataFrame, key: str, idx: str, value: str, rate: float, length: int, hop: int) -> DataFrame:
    """key, frame, centroid, bandwidth, rolloff (85 %), flatness and dominant frequency of
    the power spectrum under a Hann window; silent frames have zeros."""
    import pandas as pd

    freq, window = np.fft.rfftfreq(length, 1 / rate), np.hanning(length)

    def f(x):
        p = np.abs(np.fft.rfft(x * window)) ** 2
        total = p.sum(axis=1)
        safe = np.where(total > 0, total, 1.0)
        c = (p @ freq) / safe
        spread = np.sqrt((p * (freq[None, :] - c[:, None]) ** 2).sum(axis=1) / safe)
        roll = freq[np.argmax(np.cumsum(p, axis=1) >= 0.85 * total[:, None], axis=1)]
        flat = np.exp(np.log(p + 1e-12).mean(axis=1)) / (p + 1e-12).mean(axis=1)
        return pd.DataFrame({"centroid": c, "bandwidth": spread, "rolloff": roll, "flatness": np.where(total > 0, flat, 0.0), "dominant": np.where(total > 0, freq[p.argmax(axis=1)], 0.0)})

    return _per_frame(df, key, idx, value, length, hop, "centroid double, bandwidth double, rolloff double, flatness double, dominant double", f)


def welch(df: DataFrame, key: str, idx: str, value: str, rate: float, length: int) -> DataFrame:
    """key, frequency, power: one-sided densities of half-overlapping Hann frames without
    their means, averaged by an aggregate over frames."""
    import pandas as pd

    window = np.hanning(length + 1)[:-1]
    scale = np.full(length // 2 + 1, 2.0)
    scale[0] = 1.0
    if length % 2 == 0:
        scale[-1] = 1.0

    def f(x):
        p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window)) ** 2 * scale / (rate * (window**2).sum())
        return pd.DataFrame({"p": list(p)})

    rows = _per_frame(df, key, idx, value, length, length // 2, "p array<double>", f)
    return rows.select(key, F.posexplode("p").alias("_k", "p")).groupBy(key, "_k").agg(F.avg("p").alias("power")).select(key, (F.col("_k") * rate / length).alias("frequency"), "power")


def moving_filter(df: DataFrame, key: str, idx: str, value: str, taps: list[float]) -> DataFrame:
    """key, idx, filtered: a finite response, zeros before the start; windows within a signal."""
    w = Window.partitionBy(key).orderBy(idx)
    total = F.lit(0.0)
    for k, tap in enumerate(taps):
        total = total + float(tap) * F.coalesce(F.lag(value, k).over(w), F.lit(0.0))
    return df.select(key, idx, total.alias("filtered"))
