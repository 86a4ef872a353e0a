"""Cutting the lineage of iterative and order-dependent steps."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Fixed value: tables of up to so many rows are sent to every task, larger ones are shuffled.
FEW = 100_000


def _folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df as files in the session's checkpoint folder, or a temporary one in local mode."""
    _folder(df)
    return df.checkpoint()


_stored: list[tuple] = []


@atexit.register
def _delete_stored() -> None:
    for store, path in _stored:
        try:
            store.delete(path, True)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the checkpoint folder, smaller than a checkpoint; it goes when the process ends."""
    spark = df.sparkSession
    path = f"{_folder(df).rstrip('/')}/stored-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    _stored.append((hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def kept(df: DataFrame, key: str | None = None) -> Iterator[DataFrame]:
    """df, made once and held on the executors' disks while the block runs.

    With a key it's dealt and sorted by it, so that joins and sums by the key leave it where it is.
    """
    if key is not None:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield held
    finally:
        held.unpersist()
