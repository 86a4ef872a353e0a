"""Profiles of tables: numeric and categorical columns, duplicates, readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.missing import columns, is_numeric, present
from quarry.functions.quantiles import as_literals, exact_quantiles


def numeric_profile(df: DataFrame, names: list[str] | None = None, outlier: float = 1.5) -> DataFrame:
    """A row a numeric column: counts, moments, exact quartiles and outliers.

    Passes without a shuffle of rows: quartiles by bounded sketches and counts, one
    aggregate over all columns, a count of the values beyond the quartile fences. Where the quartiles coincide, every other
    value is an outlier. Moments are those of the population.
    """
    names = names or columns(df, "numeric")
    if not names:
        raise ValueError("there is no numeric column")
    quartiles = exact_quantiles(df, {c: (present(df, c), [0.25, 0.5, 0.75]) for c in names})
    aggs = []
    for k, name in enumerate(names):
        c = present(df, name)
        aggs += [
            F.count("*").alias(f"n{k}"), F.count(c).alias(f"have{k}"), F.avg(c).alias(f"mean{k}"), F.stddev_pop(c).alias(f"std{k}"), F.min(c).alias(f"min{k}"), F.max(c).alias(f"max{k}"),
        ]
    stats = df.agg(*aggs)
    narrow = df.select(*(present(df, c).alias(f"v{k}") for k, c in enumerate(names)))
    counts = []
    for k in range(len(names)):
        v, q = F.col(f"v{k}"), as_literals(quartiles[names[k]])
        reach = outlier * (q[2] - q[0])
        counts.append(F.count_if(F.when(q[2] == q[0], v != q[0]).otherwise((v < q[0] - reach) | (v > q[2] + reach))).alias(f"out{k}"))
    whole = stats.crossJoin(narrow.agg(*counts))
    rows = F.array(*(F.struct(
        F.lit(name).alias("column"), F.col(f"n{k}").alias("n_rows"), (F.col(f"n{k}") - F.col(f"have{k}")).alias("missing"), F.col(f"mean{k}").alias("mean"), F.col(f"std{k}").alias("std"),
        F.col(f"min{k}").alias("min"), F.col(f"max{k}").alias("max"), *(as_literals(quartiles[name])[j].alias(a) for j, a in ((1, "median"), (0, "q25"), (2, "q75"))), F.col(f"out{k}").alias("outlier_count"),
    ) for k, name in enumerate(names)))
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """column, value (as text), n: how often each present value occurs."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in names)))
    return df.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, names: list[str], top: int = 5) -> DataFrame:
    """The most frequent values of each column, ties by value."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return value_counts(df, names).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def rare_values(df: DataFrame, names: list[str], below: float = 0.01) -> DataFrame:
    """Values whose share of a column's present values is below a bound."""
    counts = value_counts(df, names)
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), "column").filter(F.col("n") / F.col("total") < below).select("column", "value", "n")


def categorical_profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row a categorical column: rows, missing, distinct values, and whether it's constant."""
    names = names or columns(df, "categorical")
    counts = value_counts(df, names).groupBy("column").agg(F.sum("n").alias("have"), F.count("*").alias("distinct"))
    base = df.agg(F.count("*").alias("n_rows")).crossJoin(df.sparkSession.createDataFrame([(c,) for c in names], "column string"))
    rows = base.join(F.broadcast(counts), "column", "left")
    return rows.select("column", "n_rows", (F.col("n_rows") - F.coalesce("have", F.lit(0))).alias("missing"), F.coalesce("distinct", F.lit(0)).alias("distinct_count"), (F.coalesce("distinct", F.lit(0)) <= 1).alias("constant"))


def duplicate_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """n_rows, distinct_rows and duplicate_rows; missing cells are equal to each other."""
    names = names or df.columns
    groups = df.select(*(present(df, c).alias(c) for c in names)).groupBy(*names).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("distinct_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def schema_differences(train: DataFrame, test: DataFrame) -> dict[str, object]:
    """Missing and extra columns, changed types, and whether the order matches; no job."""
    a, b = dict(train.dtypes), dict(test.dtypes)
    common = [c for c in train.columns if c in b]
    return {
        "missing_columns": [c for c in train.columns if c not in b], "extra_columns": [c for c in test.columns if c not in a],
        "dtype_mismatches": {c: (a[c], b[c]) for c in common if a[c] != b[c]}, "order_matches": common == [c for c in test.columns if c in a],
    }


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """value, n, share of a target's classes."""
    counts = value_counts(df, [target])
    return counts.select("value", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


def readiness(df: DataFrame, reference: DataFrame | None = None, drift_limit: float = 0.2) -> DataFrame:
    """issue, column, amount: missing values, duplicate rows and drift; none if all is ready."""
    from quarry.operators.drift import drift_report

    missing = reduce(DataFrame.unionByName, (df.agg(F.count_if(present(df, c).isNull()).cast("double").alias("amount")).select(F.lit("missing").alias("issue"), F.lit(c).alias("column"), "amount") for c in df.columns))
    found = missing.unionByName(duplicate_rows(df).select(F.lit("duplicates").alias("issue"), F.lit(None).cast("string").alias("column"), F.col("duplicate_rows").cast("double").alias("amount"))).filter("amount > 0")
    if reference is not None:
        drift = drift_report(reference, df)
        found = found.unionByName(drift.select(F.lit("drift").alias("issue"), "column", F.coalesce("psi", "tvd").alias("amount")).filter(F.col("amount") > drift_limit))
    return found


def kinds(df: DataFrame) -> dict[str, str]:
    return {c: "numeric" if is_numeric(df, c) else "categorical" for c in df.columns}
