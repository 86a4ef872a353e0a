"""Sources and sinks of signals and reports: delimited text, NumPy files and bundles."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNAL = "signal string, idx long, channel int, value double"


def load_text(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """signal (the file), idx, channel, value of delimited files; sep by the ending (.csv: comma, else tab).

    Lines are numbered within their file, so a file is read by one task; many files are
    read in parallel.
    """
    sep = sep or ("," if path.rstrip("/").endswith(".csv") else "\t")
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("signal"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("idx", "line"))
    return lines.select("signal", F.col("idx").cast("long").alias("idx"), F.posexplode(F.split("line", sep)).alias("channel", "v")).select("signal", "idx", "channel", F.col("v").try_cast("double").alias("value"))


def load_npy(spark: SparkSession, path: str) -> DataFrame:
    """The same from .npy and .npz files; a one-dimensional array is channel 0."""

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                for key, array in loaded.items() if hasattr(loaded, "files") else [("", loaded)]:
                    a = array.reshape(len(array), -1).astype(float)
                    yield pd.DataFrame({"signal": f"{name}#{key}" if key else name, "idx": np.repeat(np.arange(a.shape[0]), a.shape[1]), "channel": np.tile(np.arange(a.shape[1], dtype=np.int32), a.shape[0]), "value": a.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, SIGNAL)


def save_bundle(signals: DataFrame, metadata: dict[str, str], path: str) -> None:
    """Parquet by signal, and its metadata as one JSON row beside it."""
    signals.write.mode("overwrite").partitionBy("signal").parquet(f"{path}/signals")
    signals.sparkSession.createDataFrame([(metadata,)], "metadata map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    meta = spark.read.schema("metadata map<string,string>").json(f"{path}/metadata").first()
    return spark.read.parquet(f"{path}/signals"), dict(meta.metadata or {})


def save_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """kind: json, csv or parquet."""
    writer = report.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def sine(spark: SparkSession, n: int, rate: float, frequency: float, amplitude: float = 1.0, phase: float = 0.0) -> DataFrame:
    """idx, t, value of a sine wave; made in parallel."""
    t = F.col("id") / F.lit(float(rate))
    return spark.range(n).select(F.col("id").alias("idx"), t.alias("t"), (amplitude * F.sin(2 * np.pi * frequency * t + phase)).alias("value"))


def blobs(spark: SparkSession, n: int, centers: list[list[float]], std: float = 1.0, seed: int = 0) -> DataFrame:
    """id, label, x: normal clouds around centers, of equal sizes."""
    label = (F.col("id") % len(centers)).cast("int")
    middle = F.element_at(F.array(*(F.array(*map(F.lit, map(float, c))) for c in centers)), label + 1)
    noise = F.array(*(F.randn(seed + k) * std for k in range(len(centers[0]))))
    return spark.range(n).select("id", label.alias("label"), F.zip_with(middle, noise, lambda a, b: a + b).alias("x"))
