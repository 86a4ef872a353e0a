import numpy as np
from pyspark.sql import functions as F

from quarry.llm import topk


def brute(rows, k):
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(good):
        if q is not None and q % 5 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), i is None, i or 0) for b, (i, w) in enumerate(good) if a != b)[:k]
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored)]
    return sorted(out, key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    return sorted((tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 5 == 0, 3, **more).collect()), key=repr)


def test_ties_nulls_repeats_and_ragged_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4) / 8]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None]), (62, [float("nan"), 1.0]), (65, [float("inf")]), (70, []), (75, [0.5]), (75, [0.5]), (80, [1.0, 0.0, 0.0, 0.0]), (80, [-1.0, 0.0, 0.0, 0.0]), (None, [1.0])]
    want = brute(rows, 3)
    assert run(spark, [(*x, "clash") for x in rows]) == want
    assert run(spark, [(*x, "clash") for x in rows], block_rows=7, query_rows=4, least_blocks=3) == want


def test_repeated_ids_agree_with_the_sql(spark):
    import duckdb

    r = np.random.default_rng(3)
    rows = [(i % 50, [float(x) for x in r.integers(-9, 9, 6) / 16]) for i in range(62)]
    embeddings = spark.createDataFrame(rows, "vec_id long, embedding array<float>").toPandas()  # noqa: F841
    want = duckdb.sql(topk.OP10_SQL).fetchall()
    got = [tuple(x) for x in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted(want) and len(got) == 20 * sum(i % 20 == 0 for i, _ in rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_wide_scores_use_64_bits():
    q = np.array([[1 << 20, 3]]), np.array([[1 << 20, 1], [5, 7]])
    (_, scores), = topk.accumulate(*q)
    assert scores.tolist() == [[(1 << 40) + 3, 5 * (1 << 20) + 21]]


def test_sparse_and_dense_postings_agree():
    r = np.random.default_rng(2)
    q, c = r.integers(-9, 9, (70, 30)), r.integers(-9, 9, (400, 30)) * (r.random((400, 30)) < np.linspace(0, 1, 30))
    got = np.concatenate([s for _, s in topk.accumulate(q, c)])
    assert (got == q @ c.T).all()
