"""Rotations by little, by half turns, and sums by distinct value."""

import math

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import poses as P
from quarry.operators import preprocessing, relational, text
from quarry.plans import numbers


def test_quaternions_of_small_and_half_turns_give_the_matrix_back(spark):
    rows = [(1e-7, 2e-8, -0.2), (0.1, -3e-7, 0.2), (1e-9, 0.0, 0.0), (math.pi, 0.0, 0.0), (0.0, math.pi, 1.0), (math.pi, 0.3, -2.0), (0.0, 0.0, 0.0), (3.0, -1.0, 2.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double").select(P.rpy_to_matrix(F.col("a"), F.col("b"), F.col("c")).alias("m"))
    for r in df.select("m", P.matrix_to_quaternion("m").alias("q"), P.quaternion_to_matrix(P.matrix_to_quaternion("m")).alias("n")).collect():
        assert np.abs(np.array(r["m"]) - np.array(r["n"])).max() < 1e-14 and r["q"][0] >= 0


def test_pose_turns_round_halves_as_the_angles_themselves(spark, tmp_path):
    rows = [(i, [k / 128.0, -k / 128.0 + 1e-6 * (k % 2), (k + 1) / 128.0] + [0.0] * 61, 0) for i, k in enumerate(range(-60, 60))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in numbers.QUERIES["pose_turns"](spark, str(tmp_path)).collect()}
    want = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", *(F.round(F.col("embedding")[k].cast("double"), 6).alias(f"a{k}") for k in range(3))).collect()
    assert all(got[r["vec_id"]][f"a{k}"] == r[f"a{k}"] for r in want for k in range(3))
    assert all(r["quaternion"] and r["euler"] for r in got.values())


def test_counts_of_terms_have_no_count_a_row(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "a b"), (3, ""), (4, None)], "id long, t string")
    made = text.term_counts(df, "t", 2, 2)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r["term"]: r["n"] for r in made.collect()} == {"a b": 3, "b a": 1}


def test_pairs_of_words_within_a_window(spark):
    texts = ["a b c a", "x", "", None, "a b", "q w e r t y"]
    want = {}
    for t in texts:
        words = (t or "").split()
        for i, a in enumerate(words):
            for b in words[i + 1:i + 4]:
                want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    made = text.cooccurrence(df, "id", "t", 3)
    assert {(r["left"], r["right"]): r["n"] for r in made.collect()} == want
    assert "lambda" not in made._jdf.queryExecution().analyzed().toString()


def test_bootstrap_makes_a_number_by_one_expression(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("v"))
    made = relational.bootstrap_means(df, "id", "v", 3)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
    assert made.columns == ["replicate", "mean"] and [r["replicate"] for r in made.orderBy("replicate").collect()] == [0, 1, 2]
    assert [r["mean"] for r in relational.bootstrap_means(df.filter("id < 0"), "id", "v", 2).collect()] == [None, None]
    assert all(abs(r["mean"] - 3) < 1 for r in made.collect())


def test_power_exponent_takes_powers_by_distinct_value(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 2, 3, 3, 3, 8, 20, 55)] + [(None,)], "v double")
    made = preprocessing.power_exponent(df, "v")
    got, xs = made.first(), np.array([1, 1, 2, 3, 3, 3, 8, 20, 55.0])
    score = lambda k: (k - 1) * np.log1p(xs).sum() - len(xs) / 2 * np.log(np.var(np.log1p(xs) if abs(k) < 1e-12 else ((xs + 1) ** k - 1) / k))
    want = max((score(k), k) for k in (-2 + 4 * i / 100 for i in range(101)))
    assert abs(got["score"] - want[0]) < 1e-9 and got["exponent"] == want[1]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "var_pop" not in plan and plan.count("Aggregate") == 2
