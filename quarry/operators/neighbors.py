"""Nearest neighbours and models on array columns.

Queries and rows meet in pairs of blocks, one group a pair, so that a task holds two
blocks however large the tables are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import DISTANCES

#: Numbers in a block of vectors, rows of one at most, and pairs that a tile holds.
BLOCK, ROWS, TILE = 1 << 21, 1 << 15, 1 << 21


def _dense(vectors) -> tuple[np.ndarray, np.ndarray | None]:
    """A matrix of an Arrow list column, missing numbers as 0, and which are present (None: all)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    flat = vectors.flatten()
    width, whole = int(sizes.max(initial=0)), np.asarray(pc.is_valid(flat))
    values = np.asarray(flat.cast("double").fill_null(0.0))
    if (sizes == width).all() and whole.all():
        return values.reshape(len(sizes), width), None
    there = np.arange(width) < sizes[:, None]
    out, mask = np.zeros(there.shape), np.zeros(there.shape, bool)
    out[there], mask[there] = values, whole
    return out, mask


def _nearest(k: int, exclude_self: bool, root: bool):
    """For a block of queries and one of rows: the k nearest of each query.

    Products of matrices give squared distances within a bound of their rounding; pairs
    within it of the k-th are measured by summing the squares in order, as SQL does.
    """
    def best(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        right = right.take(pc.sort_indices(right, sort_keys=[("id", "ascending")], null_placement="at_end"))
        q_id, c_id = left.column("query").combine_chunks(), right.column("id").combine_chunks()
        (q, q_mask), (c, c_mask) = _dense(left.column("_q")), _dense(right.column("_v"))
        width = min(q.shape[1], c.shape[1])
        if q_mask is not None or c_mask is not None or q.shape[1] != c.shape[1]:
            q_mask, c_mask = ((np.ones(x.shape, bool) if m is None else m)[:, :width] for x, m in ((q, q_mask), (c, c_mask)))
        q, c = q[:, :width], c[:, :width]
        names = q_id.unique()
        q_same, c_same = (np.asarray(pc.fill_null(pc.index_in(x, value_set=names), -1)) for x in (q_id, c_id))
        own = int(np.bincount(c_same[c_same >= 0]).max(initial=0)) if exclude_self else 0
        with np.errstate(all="ignore"):
            q_sq, c_sq = q * q, c * c
            q_norm, c_norm = q_sq.sum(axis=1), c_sq.sum(axis=1)
            largest = np.where(np.isfinite(c_norm), c_norm, 0.0)
            # |q|^2 - 2 q c + |c|^2 as one product
            q_all, c_all = np.column_stack([-2.0 * q, q_norm, np.ones(len(q))]), np.column_stack([c, np.ones(len(c)), c_norm])
            rows, slack = max(1, min(len(q), 1024)), 8 * (width + 4) * np.finfo(float).eps
            columns, out = max(1, TILE // rows), []
            for start in range(0, len(q), rows):
                x = slice(start, start + rows)
                n = len(q_norm[x])
                limit = np.full(n, np.inf)
                kept_q, kept_c, kept_high = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for first in range(0, len(c), columns):
                    y = slice(first, first + columns)
                    if q_mask is None:
                        near = q_all[x] @ c_all[y].T
                    else:
                        near = q_sq[x] @ c_mask[y].T.astype(float) + q_mask[x].astype(float) @ c_sq[y].T - 2.0 * (q[x] @ c[y].T)
                        near[(q_mask[x].astype(np.float32) @ c_mask[y].T.astype(np.float32)) == 0] = np.nan
                    bound = slack * (q_norm[x] + largest[y].max(initial=0.0)) + 1e-290
                    if not first and k - 1 + own < near.shape[1]:
                        limit = np.partition(near, k - 1 + own, axis=1)[:, k - 1 + own] + bound
                        limit[~np.isfinite(limit)] = np.inf
                    # what has no number stays in, and is measured below
                    at_q, at_c = np.nonzero(~(near > (limit + bound)[:, None]))
                    if exclude_self:
                        other = q_same[start + at_q] != c_same[first + at_c]
                        at_q, at_c = at_q[other], at_c[other]
                    high = near[at_q, at_c] + bound[at_q]
                    high[~np.isfinite(high)] = np.inf
                    kept_q, kept_c, kept_high = np.concatenate([kept_q, at_q]), np.concatenate([kept_c, first + at_c]), np.concatenate([kept_high, high])
                    order = np.lexsort((kept_high, kept_q))
                    kept_q, kept_c, kept_high = kept_q[order], kept_c[order], kept_high[order]
                    begin = np.searchsorted(kept_q, np.arange(n))
                    place = np.arange(len(kept_q)) - begin[kept_q]
                    last = place == k - 1
                    limit[kept_q[last]] = np.minimum(limit[kept_q[last]], kept_high[last])
                    spare = len(kept_q) > TILE
                    if spare or y.stop >= len(c):
                        d, none = _measured(q, c, q_mask, c_mask, start + kept_q, kept_c)
                        d = np.sqrt(d) if root else d
                        order = np.lexsort((kept_c, d, none, kept_q))
                        kept_q, kept_c, kept_high, d, none = (v[order] for v in (kept_q, kept_c, kept_high, d, none))
                        top = np.arange(len(kept_q)) - np.searchsorted(kept_q, kept_q) < k
                        kept_q, kept_c, kept_high, d, none = (v[top] for v in (kept_q, kept_c, kept_high, d, none))
                out.append((start + kept_q, kept_c, d, none))
        at_q, at_c, d, none = (np.concatenate(v) for v in zip(*out))
        return pa.table({"query": q_id.take(pa.array(at_q)), "id": c_id.take(pa.array(at_c)), "distance": pa.array(d, mask=none)})

    return best


def _measured(q, c, q_mask, c_mask, at_q, at_c) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squared differences in order of place, and which pairs have no place in common."""
    total, none, step = np.zeros(len(at_q)), np.zeros(len(at_q), bool), 1 << 15
    for start in range(0, len(at_q), step):
        a, b = at_q[start:start + step], at_c[start:start + step]
        square = (q[a] - c[b]).T
        square = square * square
        if q_mask is not None:
            both = (q_mask[a] & c_mask[b]).T
            square, none[start:start + step] = np.where(both, square, 0.0), ~both.any(axis=0)
        part = total[start:start + step]
        for row in square:
            part += row
    if not q.shape[1]:
        none[:] = True
    return total, none


def _in_blocks(q: DataFrame, r: DataFrame, k: int, exclude_self: bool, root: bool) -> DataFrame:
    (m, a), (n, b) = (x.agg(F.count("*"), F.max(F.size(c))).first() for x, c in ((q, "_q"), (r, "_v")))
    size = max(1, min(ROWS, BLOCK // max(1, a or 1, b or 1)))
    cores = q.sparkSession.sparkContext.defaultParallelism
    n_q = max(1, -(-m // size))
    n_c = max(1, -(-n // size), min(-(-m * n // (n_q * TILE)), -(-2 * cores // n_q)))
    block = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # a stated number of parts isn't merged again, so that pairs of blocks run apart
    parts = min(3 * n_q * n_c, 2000)
    left = q.select(block("query", n_q, 1).alias("qb"), every(n_c).alias("cb"), "query", "_q").repartition(parts, "qb", "cb")
    right = r.select(every(n_q).alias("qb"), block("id", n_c, 2).alias("cb"), "id", "_v").repartition(parts, "qb", "cb")
    types = dict(left.dtypes)["query"], dict(right.dtypes)["id"]
    best, schema = _nearest(k, exclude_self, root), f"query {types[0]}, id {types[1]}, distance double"

    def run(one, two):
        import pyarrow as pa

        if not one.num_rows or not two.num_rows:
            return pa.table({"query": one.column("query").slice(0, 0), "id": two.column("id").slice(0, 0), "distance": pa.array([], pa.float64())})
        return best(one, two)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(run, schema)


def neighbors(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int, metric: str = "euclidean", exclude_self: bool = True) -> DataFrame:
    """query, id, distance, rank: the k nearest rows of each query, ties by id.

    All pairs are measured, in pairs of blocks; a block gives k rows a query, so that is
    what is shuffled for the ranks. Pairs without a distance come last, as in SQL.
    """
    q = queries.select(F.col(id_col).alias("query"), F.col(vector).alias("_q"))
    r = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("_v"))
    if exclude_self:
        q, r = q.filter(F.col("query").isNotNull()), r.filter(F.col("id").isNotNull())
    if metric in ("euclidean", "sqeuclidean"):
        near = _in_blocks(q, r, k, exclude_self, metric == "euclidean")
    else:
        pairs = q.hint("shuffle_replicate_nl").join(r, F.col("query") != F.col("id") if exclude_self else F.lit(True))
        near = pairs.select("query", "id", DISTANCES[metric](F.col("_q"), F.col("_v")).alias("distance"))
    w = Window.partitionBy("query").orderBy(F.asc_nulls_last("distance"), "id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_classify(found: DataFrame, labels: DataFrame, id_col: str, label: str, weights: str = "uniform") -> DataFrame:
    """query, predicted: the label with most votes among the neighbours, ties to the least label."""
    vote = F.lit(1.0) if weights == "uniform" else 1.0 / F.greatest(F.col("distance"), F.lit(1e-12))
    votes = found.join(labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")), "id").groupBy("query", "label").agg(F.sum(vote).alias("v"))
    w = Window.partitionBy("query").orderBy(F.desc("v"), "label")
    return votes.withColumn("r", F.row_number().over(w)).filter("r = 1").select("query", F.col("label").alias("predicted"))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """label, centroid: mean vectors, by position, so that a class's rows are summed before the shuffle."""
    flat = rows.select(F.col(label).alias("label"), F.posexplode(vector).alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x"))
    return flat.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centroid"))


def _beside(rows: DataFrame, table: DataFrame, fields: list[str]) -> DataFrame:
    """rows with _all, the few rows of a model as an array of structs: a choice among them is an expression of the row, without a shuffle."""
    return rows.crossJoin(F.broadcast(table.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_all"))))


def nearest_centroid(rows: DataFrame, id_col: str, vector: str, centres: DataFrame) -> DataFrame:
    """id, predicted: the label of the nearest centroid, ties to the least label."""
    both = _beside(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("_v")), centres, ["label", "centroid"])
    near = F.array_min(F.transform("_all", lambda c: F.struct(DISTANCES["euclidean"](F.col("_v"), c["centroid"]).alias("d"), c["label"].alias("label"))))
    return both.select("id", near["label"].alias("predicted"))


def gaussian_nb(rows: DataFrame, label: str, names: list[str], smoothing: float = 1e-9) -> DataFrame:
    """label, n, and mean and variance (smoothing added) of each feature by class."""
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in names), *((F.var_pop(c) + smoothing).alias(f"var_{c}") for c in names))


def gaussian_nb_predict(rows: DataFrame, id_col: str, names: list[str], model: DataFrame) -> DataFrame:
    """id, predicted by the largest joint log likelihood; the model's few rows are broadcast."""
    both = _beside(rows.select(F.col(id_col).alias("id"), *names), model, ["label", "n", *(f"{k}_{c}" for c in names for k in ("mean", "var"))])

    def like(m):
        parts = (-0.5 * F.ln(m[f"var_{c}"] * 6.283185307179586) - F.pow(F.col(c) - m[f"mean_{c}"], 2) / (2 * m[f"var_{c}"]) for c in names)
        return F.struct(sum(parts, F.ln(m["n"])).alias("l"), m["label"].alias("label"))

    return both.select("id", F.array_max(F.transform("_all", like))["label"].alias("predicted"))


def ols(rows: DataFrame, names: list[str], target: str, ridge: float = 0.0, intercept: bool = True) -> dict[str, float]:
    """Coefficients by the normal equations: one aggregate of products, solved on the driver.

    ridge is added to the diagonal of the features, not of the intercept.
    """
    import numpy as np

    x = [*((F.lit(1.0),) if intercept else ()), *(F.col(c).cast("double") for c in names)]
    y, k = F.col(target).cast("double"), len(names) + intercept
    sums = rows.dropna(subset=[*names, target]).agg(*(F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(x[i] * y).alias(f"b{i}") for i in range(k))).first()
    g, b = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), np.array([sums[f"b{i}"] for i in range(k)])
    g += np.diag([0.0] * intercept + [ridge] * len(names))
    found = np.linalg.lstsq(g, b, rcond=None)[0]
    return dict(zip([*(["intercept"] if intercept else []), *names], map(float, found)))


def kmeans(rows: DataFrame, id_col: str, vector: str, starts: DataFrame, iterations: int = 5) -> DataFrame:
    """label, centroid after rounds of Lloyd's algorithm from starts (label, centroid).

    A round is one pass with the k centres beside each row and one aggregate of sums by
    centre and position; only k rows reach the driver. Empty clusters keep their centre.
    """
    spark = rows.sparkSession
    centres = {r["label"]: list(r["centroid"]) for r in starts.collect()}
    for _ in range(iterations):
        table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in sorted(centres.items())], "label long, centroid array<double>")
        near = nearest_centroid(rows.select(F.col(vector).alias("v")), "v", "v", table)
        new = centroids(near.select(F.col("predicted").alias("label"), F.col("id").alias("v")), "label", "v")
        centres |= {r["label"]: list(r["centroid"]) for r in new.collect()}
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in sorted(centres.items())], "label long, centroid array<double>")
