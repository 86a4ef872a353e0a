"""Relational operators of the analytics layer: subsets, lookups, set operations, ranks,
mergeable aggregates, samples and event-time helpers. Plans are left to Catalyst: no join
here names a strategy, and aggregates combine before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.folds import numbered


def subset(df: DataFrame, wanted: Sequence[str | int] | slice, remainder: str = "drop") -> DataFrame:
    """Columns by name, place or slice; the others after them with remainder "passthrough"."""
    names = df.columns[wanted] if isinstance(wanted, slice) else [df.columns[w] if isinstance(w, int) else w for w in wanted]
    unknown = [n for n in names if n not in df.columns]
    if unknown or remainder not in ("drop", "passthrough"):
        raise ValueError(f"unknown columns {unknown} or remainder {remainder!r}")
    return df.select(*names, *(c for c in df.columns if remainder == "passthrough" and c not in names))


def by_mask(df: DataFrame, mask: Sequence[bool]) -> DataFrame:
    """Columns where the mask holds."""
    if len(mask) != len(df.columns):
        raise ValueError("one entry a column")
    return df.select(*(c for c, kept in zip(df.columns, mask) if kept))


def above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return df.filter(F.col(column) > threshold)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default=None, on_miss: str = "default") -> DataFrame:
    """Adds value from a table with a row a key; a miss gives the default, or is an error with on_miss "error"."""
    right = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_hit"))
    found = df.join(right, F.col(key) == F.col("_k"), "left")
    if on_miss == "error":
        miss = F.raise_error(F.concat(F.lit(f"{key} not in the table: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        taken = F.when(F.col("_hit"), F.col("_v")).otherwise(miss.cast(right.schema["_v"].dataType))
    else:
        taken = F.when(F.col("_hit"), F.col("_v")).otherwise(F.lit(default))
    return found.withColumn(value, taken).drop("_k", "_v", "_hit")


def semi(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with a match."""
    return df.join(other, list(on), "left_semi")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without one."""
    return df.join(other, list(on), "left_anti")


def in_range(df: DataFrame, ranges: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """Rows with every range (low <= column < high) that holds them. ranges should be few: they meet all rows."""
    return df.join(ranges, (F.col(column) >= F.col(low)) & (F.col(column) < F.col(high)))


def zipped(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows side by side in their orders; the longer table's rest is left out."""
    a, b = numbered(left, *left_order, name="_place"), numbered(right, *right_order, name="_place")
    return a.join(b, "_place").drop("_place")


def first_seen_mode(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value a key; of ties the one that comes first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first").cast("double"))).alias("mode"))


def partials(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, total, low, high and m2 (squares around the mean) a key: mergeable, so they can be kept a batch and combined."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population variance and range from partials of any number of batches."""
    spread = F.sum(F.col("m2") + F.col("total") * F.col("total") / F.col("n")) - F.sum("total") * F.sum("total") / F.sum("n")
    return parts.filter("n > 0").groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), (spread / F.sum("n")).alias("variance"), F.min("low").alias("low"), F.max("high").alias("high"))


def bootstrap_means(df: DataFrame, id_col: str, value: str, replicates: int = 100, seed: int = 0) -> DataFrame:
    """replicate, mean: each row counts as often as a Poisson draw of mean 1 by a hash of its id, the replicate and the seed.

    Rows meet the replicates one by one and are summed before the shuffle: one short
    expression, which a column a replicate and step would make too long to compile.
    """
    from math import exp, factorial

    steps, total = [], 0.0
    for k in range(12):
        total += exp(-1) / factorial(k)
        steps.append(total)
    draw = F.when(F.col("_u") <= steps[0], 0.0)
    for k, s in enumerate(steps[1:], 1):
        draw = draw.when(F.col("_u") <= s, float(k))
    draw = draw.otherwise(float(len(steps)))
    rows = df.select(F.col(id_col).alias("_id"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    drawn = rows.withColumn("replicate", F.explode(F.array(*map(F.lit, range(replicates)))))
    drawn = drawn.select("replicate", "_v", ((F.pmod(F.xxhash64("_id", F.lit(seed), "replicate"), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("_u")).select("replicate", "_v", draw.alias("_w"))
    sums = drawn.groupBy("replicate").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("mean"))
    every = df.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    return every.join(F.broadcast(sums), "replicate", "left")


def cubed(df: DataFrame, keys: Sequence[str], value: str, rollup: bool = False) -> DataFrame:
    """Counts and sums for every subset of the keys (or every prefix); level tells which keys are summed over."""
    grouped = df.rollup(*keys) if rollup else df.cube(*keys)
    return grouped.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum(value).alias("total"))


def sketch(df: DataFrame, column: str, relative_error: float = 0.01) -> DataFrame:
    """About how many distinct values, and about the quartiles."""
    return df.agg(F.approx_count_distinct(column, relative_error).alias("distinct"), F.percentile_approx(column, [0.25, 0.5, 0.75], round(1 / relative_error)).alias("quartiles"))


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """value, n, share: the share of rows at or under each distinct value. One row a value is ordered, after a map-side count."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    w = Window.orderBy("value")
    return counts.select("value", "n", (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


def prefix_sums(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Sums of a grid over all rows and columns up to each cell: along the row, then down the columns. The grid is dense."""
    across = df.withColumn("_a", F.sum(value).over(Window.partitionBy(row).orderBy(column)))
    return across.withColumn("integral", F.sum("_a").over(Window.partitionBy(column).orderBy(row))).drop("_a")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], tiles: int = 4) -> DataFrame:
    """Adds rank, dense_rank, tile and the number of the row, a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.ntile(tiles).over(w).alias("tile"), F.row_number().over(w).alias("row"))


def first_last(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The first and the last value a key, by one aggregate."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def leaderboard(df: DataFrame, name: str, score: str, k: int | None = None) -> DataFrame:
    """place, name, score: the highest first, ties by name; the k best, where a limit is asked for."""
    best = df.select(name, score).orderBy(F.desc(score), F.asc(name))
    best = best.limit(k) if k else best
    return best.select(F.row_number().over(Window.orderBy(F.desc(score), F.asc(name))).alias("place"), name, score)


def sampled(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in a seeded order: the ones with the least hashes, so no full sort."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(n)


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).distinct() if a.columns != b.columns else a.subtract(b)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def in_either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def inserted(known: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """known and the new rows whose keys it lacks, one a key, the first in order."""
    fresh = new.join(known, list(keys), "left_anti").groupBy(*keys).agg(F.min_by(F.struct(*new.columns), order).alias("_r")).select("_r.*")
    return known.unionByName(fresh.select(*known.columns))


def sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """key, start, end, n: rows of a key no further than gap from the one before."""
    w = F.session_window(F.col(ts), gap)
    return df.groupBy(key, w).agg(F.count("*").alias("n"), F.max(ts).alias("_last")).select(key, F.col("session_window.start").alias("start"), F.col("_last").alias("end"), "n")


def sliding(df: DataFrame, key: str, ts: str, value: str, width: str, slide: str) -> DataFrame:
    w = F.window(F.col(ts), width, slide)
    return df.groupBy(key, w).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").alias("start"), "n", "total")


def last_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n latest rows a key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_r") <= n).drop("_r")


def late(df: DataFrame, key: str, arrival: str, ts: str, delay_seconds: float) -> DataFrame:
    """Adds late: whether a row's time lies more than the delay before the latest time that its key had shown by then, as a watermark would judge."""
    seen = F.max(ts).over(Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    behind = (F.unix_micros(seen.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    return df.withColumn("late", F.coalesce(behind > delay_seconds, F.lit(False)))


def baseline(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.2, limit: float = 3.0, warm: int = 5) -> DataFrame:
    """Adds mean (of the rows before, weighed by (1 - alpha) a step) and state of a monitored
    series: "warming" for warm rows, then "alert" where the value lies more than limit deviations away, else
    "normal". The recursion goes over a key's rows in order, so a key's series goes to one
    task and must fit in its memory; keys run in parallel."""
    def fold(rows):
        import pandas as pd

        rows = rows.sort_values(order)
        means, states, m, q = [], [], None, 0.0
        for k, v in enumerate(rows[value].to_numpy(float)):
            means.append(m)
            if m is None:
                m = v
                states.append("warming")
                continue
            d = v - m
            states.append("warming" if k < warm else "alert" if abs(d) > limit * q**0.5 else "normal")
            m, q = m + alpha * d, (1 - alpha) * (q + alpha * d * d)
        return pd.DataFrame({key: rows[key], order: rows[order], value: rows[value].astype(float), "mean": pd.Series(means, index=rows.index, dtype=float), "state": pd.Series(states, index=rows.index, dtype=object)})

    types = dict(df.dtypes)
    return df.select(key, order, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(fold, f"`{key}` {types[key]}, `{order}` {types[order]}, `{value}` double, mean double, state string")
