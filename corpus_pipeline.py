"""A corpus pipeline of five operators of quarry.llm, from the table documents to packed
sequences. Each stage takes what the one before kept, as written Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import dedup, langid, mixing, packing, pii
from quarry.llm.common import materialised, release, table, tasks, text_key, unused

#: A document stays if its language is known with at least this probability.
LEAST_SCORE = 0.5
#: Rows that go to a Python worker at a time. Whole texts, some of them long, stand in memory three times over on the way.
BATCH_ROWS = 1024


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, if they are larger, for the stages that give texts to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang becomes the prediction.

    The model learns from the labelled rows of the input themselves. Texts without
    letters, and those whose language is less likely than LEAST_SCORE, go.
    """
    _small_batches(spark)
    model = langid.train(docs, F.lit(True))
    pred, score = unused(docs, "_pred"), unused(docs, "_score")
    found = langid.identify(docs, model, pred_col=pred, score_col=score)
    kept = found.filter((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(pred)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least id, a null id last, and the
    least text key. Rows that repeat it go too."""
    _small_batches(spark)
    found = dedup.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    least = found.groupBy("class_key").agg(first.alias("s")).select(F.col("s.doc_id").alias("_id"), F.col("s.text_key").alias("_least"))
    key = unused(docs, "_key")
    rows = docs.withColumn(key, text_key("text")).alias("d")
    same = (F.col(f"d.{key}") == F.col("l._least")) & F.col("d.doc_id").eqNullSafe(F.col("l._id"))
    return rows.join(least.alias("l"), same).select("d.*").dropDuplicates(["doc_id", key]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in angle brackets."""
    return pii.redacted(docs)


#: Parts of a copy that running sums count in whole numbers.
UNIT = 1 << 32


def rounded(plan: DataFrame) -> DataFrame:
    """_key, _copies from _key, source, size, taken: systematic rounding of taken / size.

    In the order of size, the longest first, the rounded running sums of the fractions stay within half a
    copy of the exact ones, so a source's words differ by half its longest document at
    most. Running sums come from a range partitioning, local sums and one sum a part.
    """
    spark = plan.sparkSession
    part = F.expr(f"(taken % size) * {UNIT} div size")
    rows = plan.select("_key", "source", (-F.col("size")).alias("_less"), F.expr("taken div size").alias("_whole"), part.alias("_part"), F.xxhash64("_key", F.lit("copies")).alias("_draw"))
    order = ["_less", "_draw", "_key"]
    rows = materialised(rows.repartitionByRange(tasks(spark), "source", *order).withColumn("_task", F.spark_partition_id()), "fractions")
    sums = rows.groupBy("source", "_task").agg(F.sum("_part").alias("_sum"))
    before = sums.select(F.col("source").alias("_source"), "_task", (F.sum("_sum").over(Window.partitionBy("source").orderBy("_task")) - F.col("_sum")).alias("_before"))
    local = rows.withColumn("_to", F.sum("_part").over(Window.partitionBy("_task", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    both = local.alias("l").join(before.alias("b"), (F.col("l._task") == F.col("b._task")) & F.col("source").eqNullSafe(F.col("_source")))
    count = lambda x: F.floor((x + UNIT // 2) / F.lit(float(UNIT)))
    to = F.col("_before") + F.col("_to")
    return both.select("_key", (F.col("_whole") + count(to) - count(to - F.col("_part"))).cast("int").alias("_copies"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: taken / size, by running sums of
    it within a source in a seeded order, so that a source's words end within half
    its longest document of those taken. Up to three times."""
    # ids may repeat with different texts; the stage before left no row twice
    key, copy = unused(docs, "_key"), unused(docs, "_copy")
    keyed = docs.withColumn(key, F.concat_ws(":", "doc_id", text_key("text")))
    slim = keyed.select(F.col(key).alias("_key"), "text", "source")
    plan = mixing.mix(slim, id_col="_key").withColumnRenamed("doc_id", "_key").filter(F.col("size") > 0)
    copies = rounded(plan.join(slim.select("_key", "source"), "_key")).filter(F.col("_copies") > 0)
    copies = copies.select(F.col("_key").alias(key), F.sequence(F.lit(1), F.col("_copies")).alias(copy))
    return keyed.join(copies, key).withColumn(copy, F.explode(copy)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    _small_batches(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the packing's plan.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialised(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
