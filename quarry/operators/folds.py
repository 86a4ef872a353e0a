"""Cross-validation folds as columns. All need an id column that orders the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.state import checkpointed


def numbered(df: DataFrame, *order: Column | str, name: str = "_row") -> DataFrame:
    """Adds the number of each row, from 0, in a total order.

    A range partitioning sorts the rows in parallel; numbers within partitions and one
    count a partition make the number, so that no task sees all rows. The partitioning
    is checkpointed: a second run could sample other ranges, and numbers would clash.
    """
    exprs = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = df.select("*", *(e.alias(f"_o{k}") for k, e in enumerate(exprs)))
    names = [f"_o{k}" for k in range(len(exprs))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(keys.repartitionByRange(parts, *names).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*names)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_local") + F.col("_before") - 1).drop("_part", "_local", "_before", *names)


def _ntile(row: Column, n: Column, k: int) -> Column:
    """Fold of a row number: contiguous, the first n % k folds one row larger."""
    size, more = F.floor(n / k), n % k
    big = more * (size + 1)
    return F.when(row < big, F.floor(row / (size + 1))).otherwise(more + F.floor((row - big) / F.greatest(size, F.lit(1)))).cast("int")


def kfold(df: DataFrame, id_col: str, n_splits: int = 5, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """Adds fold: contiguous by id, or by a seeded hash of it."""
    order = [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)] if shuffle else [F.col(id_col)]
    n = df.agg(F.count("*").alias("_n"))
    return numbered(df, *order).crossJoin(F.broadcast(n)).withColumn("fold", _ntile(F.col("_row"), F.col("_n"), n_splits)).drop("_row", "_n")


def stratified_kfold(df: DataFrame, id_col: str, label: str, n_splits: int = 5) -> DataFrame:
    """Adds fold: each class is cut in contiguous folds of its own."""
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.orderBy("_label")) - F.col("_n"))
    rows = numbered(df, label, id_col).join(F.broadcast(first), F.col(label).eqNullSafe(F.col("_label")))
    return rows.withColumn("fold", _ntile(F.col("_row") - F.col("_first"), F.col("_n"), n_splits)).drop("_row", "_label", "_n", "_first")


def group_kfold(df: DataFrame, group: str, n_splits: int = 5) -> DataFrame:
    """Adds fold: whole groups, the largest first to the smallest fold so far.

    One row a group reaches the driver; use it where groups are few.
    """
    sizes = sorted(((r[1], r[0]) for r in df.groupBy(group).agg(F.count("*")).collect()), key=lambda x: (-x[0], str(x[1])))
    if len(sizes) < n_splits:
        raise ValueError("fewer groups than folds")
    load, rows = [0] * n_splits, []
    for n, g in sizes:
        k = load.index(min(load))
        load[k] += n
        rows.append((g, k))
    folds = df.sparkSession.createDataFrame(rows, f"_g {df.schema[group].dataType.simpleString()}, fold int")
    return df.join(F.broadcast(folds), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def time_series_folds(df: DataFrame, order: str, n_splits: int = 5, test_size: int | None = None, gap: int = 0, max_train_size: int | None = None) -> DataFrame:
    """fold and part (train or test) for each row and fold it takes part in."""
    n = df.agg(F.count("*").alias("_n"))
    rows = numbered(df, order).crossJoin(F.broadcast(n)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    size = F.lit(test_size) if test_size else F.floor(F.col("_n") / (n_splits + 1))
    start = F.col("_n") - (n_splits - F.col("fold")) * size
    row, stop = F.col("_row"), start - gap
    train = row < stop if max_train_size is None else (row < stop) & (row >= stop - max_train_size)
    part = F.when((row >= start) & (row < start + size), "test").when(train, "train")
    return rows.withColumn("part", part).filter(F.col("part").isNotNull()).drop("_row", "_n")


def train_test_split(df: DataFrame, id_col: str, test_size: float = 0.25, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """Adds part: exactly ceil(n * test_size) rows are test, the first after the shuffle."""
    order = [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)] if shuffle else [F.col(id_col)]
    n = df.agg(F.ceil(F.count("*") * test_size).alias("_n"))
    return numbered(df, *order).crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col("_row") < F.col("_n"), "test").otherwise("train")).drop("_row", "_n")


def shuffle_split(df: DataFrame, id_col: str, n_splits: int = 10, test_share: float = 0.1, train_share: float | None = None, seed: int = 0) -> DataFrame:
    """split, role and each row's columns: in each split ceil(test_share * n) rows are "test", the next
    floor(train_share * n) "train" (all others where none is given), in a seeded order of its own."""
    n = df.count()
    tests = -int(-test_share * n // 1)
    trains = n - tests if train_share is None else min(int(train_share * n), n - tests)
    out = None
    for k in range(n_splits):
        rows = numbered(df, F.xxhash64(F.col(id_col), F.lit(seed), F.lit(k)), F.col(id_col))
        rows = rows.withColumn("split", F.lit(k)).withColumn("role", F.when(F.col("_row") < tests, "test").when(F.col("_row") < tests + trains, "train")).filter("role IS NOT NULL").drop("_row")
        out = rows if out is None else out.unionByName(rows)
    return out


def repeated_kfold(df: DataFrame, id_col: str, n_splits: int = 5, n_repeats: int = 10, seed: int = 0) -> DataFrame:
    """Adds repeat and fold: as many shuffled foldings, each with a seed of its own."""
    out = None
    for k in range(n_repeats):
        rows = kfold(df, id_col, n_splits, True, seed + k).withColumn("repeat", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def leave_one_out(df: DataFrame, id_col: str) -> DataFrame:
    """Adds fold: each row is its own, by id."""
    return numbered(df, id_col, name="fold")


def learning_curve(df: DataFrame, id_col: str, fit, score, shares: tuple[float, ...] = (0.1, 0.33, 0.55, 0.78, 1.0), n_splits: int = 5, seed: int = 0) -> list[dict]:
    """Scores by size of the training part: fit(rows) gives a model, score(model, rows) a
    number. Training rows are the first of a seeded order, so larger parts hold the smaller."""
    rows, out = kfold(df, id_col, n_splits), []
    draw = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    for share in shares:
        trains, tests = [], []
        for k in range(n_splits):
            part = rows.filter((F.col("fold") != k) & (draw < share)).drop("fold")
            model = fit(part)
            trains.append(score(model, part))
            tests.append(score(model, rows.filter(F.col("fold") == k).drop("fold")))
        out.append({"share": share, "train": trains, "test": tests})
    return out


def validation_curve(df: DataFrame, id_col: str, fit, score, values: list, n_splits: int = 5) -> list[dict]:
    """Scores by value of one parameter: fit(rows, value) gives a model."""
    rows, out = kfold(df, id_col, n_splits), []
    for value in values:
        trains, tests = [], []
        for k in range(n_splits):
            part = rows.filter(F.col("fold") != k).drop("fold")
            model = fit(part, value)
            trains.append(score(model, part))
            tests.append(score(model, rows.filter(F.col("fold") == k).drop("fold")))
        out.append({"value": value, "train": trains, "test": tests})
    return out


def drawn_parameters(choices: dict[str, list], n: int = 10, seed: int = 0) -> list[dict]:
    """n different settings from lists of values, or all where there are fewer."""
    import random
    from itertools import product

    total, r = 1, random.Random(seed)
    for v in choices.values():
        total *= len(v)
    names = sorted(choices)
    if total <= n:
        return [dict(zip(names, p)) for p in product(*(choices[k] for k in names))]
    out = []
    for at in r.sample(range(total), n):
        setting = {}
        for k in names:
            at, place = divmod(at, len(choices[k]))
            setting[k] = choices[k][place]
        out.append(setting)
    return out
