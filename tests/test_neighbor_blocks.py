"""Nearest neighbours in blocks: the same rows as all pairs, on odd vectors too."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import neighbors


def _all_pairs(rows, queries, k):
    out = {}
    for q in queries:
        found = []
        for i, v in rows.items():
            if i == q:
                continue
            both = [(a, b) for a, b in zip(rows[q] or [], v or []) if a is not None and b is not None]
            total = 0.0
            for a, b in both:
                total += (a - b) * (a - b)
            found.append((not both, np.sqrt(total), i))
        out[q] = [(i, None if none else d) for none, d, i in sorted(found)[:k]]
    return out


def _found(spark, rows, k, every=1):
    df = spark.createDataFrame(list(rows.items()), "id long, v array<double>")
    got = {}
    for r in neighbors.neighbors(df.filter(F.col("id") % every == 0), df, "id", "v", k).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["distance"]))
    return got


def test_blocks_give_the_rows_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "ROWS", 50)
    r = np.random.default_rng(1)
    vectors = [r.normal(size=6).round(1).tolist() for _ in range(90)]
    # copies of vectors, so that ranks of equal distances go by id, and near ones
    rows = {i: list(vectors[i % 90]) for i in range(150)} | {150 + i: (np.array(vectors[i]) + 1e-9).tolist() for i in range(20)}
    assert _found(spark, rows, 4, 3) == _all_pairs(rows, [i for i in rows if i % 3 == 0], 4)


def test_missing_numbers_come_last_or_are_left_out_as_in_sql(spark):
    rows = {0: [1.0, 2.0], 1: None, 2: [1.0, None], 3: [4.0], 4: [], 5: [1.5, 2.5, 9.0], 6: [-1.0, 2.0]}
    assert _found(spark, rows, 6) == _all_pairs(rows, list(rows), 6)


def test_all_pairs_of_many_vectors_in_seconds(spark):
    import time

    df = spark.range(6000).select("id", F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.sin(F.col("id") * i * 0.37)).alias("v"))
    start = time.time()
    assert neighbors.neighbors(df, df, "id", "v", 5).count() == 30000
    assert time.time() - start < 40
