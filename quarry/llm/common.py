"""What the operators of this subpackage share: tables, the shared folder, keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where the session names none, as in local tests, one is made for it; that
    folder is only right when driver and executors are on one machine.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Folders written by this process, with the Hadoop object that deletes each.
_folders: dict[str, tuple] = {}


def _delete(path: str) -> None:
    store, hadoop_path = _folders.pop(path, (None, None))
    if store is not None:
        store.delete(hadoop_path, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_folders):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return


def owned_dir(spark: SparkSession, what: str) -> str:
    """A new path as shared_dir gives it, deleted when this process ends."""
    path = shared_dir(spark, what)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    _folders[path] = (hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path)
    return path


def materialised(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again.

    It cuts the lineage, so a lost executor costs a re-read of files, and it keeps
    later stages from running the steps above it twice. The folder goes when the
    process ends, or by release().
    """
    spark = df.sparkSession
    path = owned_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the folders of materialised frames that nothing will read again."""
    for df in frames:
        if getattr(df, "_folder", None):
            _delete(df._folder)


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(left: DataFrame, right: DataFrame, on: str, rows: int, how: str = "left") -> DataFrame:
    """Joins left with right, which has a row a key at most, on a key that may hold any share of left.

    Of a key with more than rows / (4 tasks) of left's rows (there are under 4 tasks
    of them, so their table is broadcast), left's rows are dealt over several parts and right's row
    is copied to each. left must be read from files, so that its rows stay in order.
    """
    spark = left.sparkSession
    most = max(1, rows // (4 * tasks(spark)))
    key, parts, part = (unused(left, unused(right, c)) for c in ("_on", "_parts", "_part"))
    many = left.groupBy(on).agg(F.count("*").alias(parts)).filter(F.col(parts) > most)
    many = materialised(many.select(F.col(on).alias(key), F.ceil(F.col(parts) / most).cast("int").alias(parts)), "frequent")
    same = F.col(on).eqNullSafe(F.col(key))
    dealt = left.join(F.broadcast(many), same, "left").withColumn(part, F.when(F.col(parts).isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col(parts))).cast("int")).drop(key, parts)
    copied = right.join(F.broadcast(many), same, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(key, parts)
    return dealt.join(copied, [on, part], how).drop(part)


def text_key(text: Column | str) -> Column:
    """128 bits of a text as a string: equal texts, equal keys (null: as empty)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.md5(t.cast("binary"))


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session, read when it's called."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
