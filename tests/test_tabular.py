import math

import pytest

from quarry.operators import contract, drift, folds, graph, metrics, preprocessing, quality, stats, text, timeseries


def test_profile_counts_outliers_and_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (1.0, "b"), (100.0, "b"), (float("nan"), None)], "x0 double, x1 string")
    row = quality.numeric_profile(df).first()
    assert (row["column"], row["n_rows"], row["missing"], row["outlier_count"]) == ("x0", 5, 1, 1)
    assert quality.duplicate_rows(df).first().duplicate_rows == 1
    assert quality.rare_values(df, ["x1"], 0.3).count() == 0
    assert quality.categorical_profile(df).first().missing == 1


def test_drift_of_small_tables(spark):
    a = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "a")], "age double, city string")
    b = spark.createDataFrame([(5.0, "new"), (6.0, "new")], "age double, city string")
    rows = {r["column"]: r for r in drift.drift_report(a, b).collect()}
    assert rows["city"].unseen_rate == 1.0 and rows["city"].tvd > 0
    assert rows["age"].mean_diff == pytest.approx(3.5)
    assert quality.schema_differences(a, b)["order_matches"]
    constant = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert drift.numeric_drift(constant, constant, "v").first().psi == pytest.approx(0.0)


def test_contract_codes(spark):
    rules = contract.DataContract({"age": contract.Rule("numeric", 0, 120, max_missing=0.1), "city": contract.Rule(allowed=("bj", "sh"))})
    bad = spark.createDataFrame([(140.0, "new"), (None, "bj")], "age double, city string")
    assert {r.code for r in rules.validate(bad).collect()} == {"range_max", "allowed_values", "missing_rate"}
    good = spark.createDataFrame([(25.0, "bj"), (35.0, "sh")], "age double, city string")
    assert rules.validate(good).count() == 0


def test_folds_cover_each_row_once(spark):
    df = spark.range(23).withColumnRenamed("id", "k").repartition(5)
    rows = folds.kfold(df, "k", 5, shuffle=True, seed=3).collect()
    assert sorted(r.k for r in rows) == list(range(23))
    assert sorted(sum(r.fold == f for r in rows) for f in range(5)) == [4, 4, 5, 5, 5]
    assert sum(r.part == "test" for r in folds.train_test_split(df, "k", 0.25, seed=1).collect()) == math.ceil(23 * 0.25)


def test_confusion_of_strings(spark):
    df = spark.createDataFrame([("dog", "cat"), ("cat", "cat"), ("dog", "dog"), ("bird", "bird")], "y string, p string")
    n = {(r.label, r.predicted): r.n for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert [[n[a, b] for b in ("bird", "cat", "dog")] for a in ("bird", "cat", "dog")] == [[1, 0, 0], [0, 1, 0], [0, 1, 1]]


def test_scaling_and_bins(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (5.0, 7.0), (8.0, 7.0)], "a double, c double")
    rows = preprocessing.standard_scale(df, ["a", "c"]).collect()
    assert sum(r.a for r in rows) == pytest.approx(0) and {r.c for r in rows} == {0.0}
    assert {r.c for r in preprocessing.minmax_scale(df, ["c"]).collect()} == {0.0}
    assert [r.bin for r in preprocessing.discretize(df, "a", 2).orderBy("a").collect()] == [0, 0, 1, 1]
    assert preprocessing.polynomial(df, ["a", "c"], 2).columns == ["1", "a", "c", "a*a", "a*c", "c*c"]


def test_normal_distribution(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x / 4,) for x in range(-30, 31)], "z double")
    for r in df.select("z", stats.normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-9, abs=1e-300)


def test_series(spark):
    df = spark.createDataFrame([("s", t, float(x)) for t, x in enumerate([1, 2, 4, 7, 11])], "k string, t int, x double")
    assert [r["diff"] for r in timeseries.difference(df, "k", "t", "x").orderBy("t").collect()] == [1, 2, 3, 4]
    assert [r.mean for r in timeseries.rolling_mean(df, "k", "t", "x", 2).orderBy("t").collect()] == [1.5, 3, 5.5, 9]
    lag = timeseries.lagged_matrix(spark.createDataFrame([("s", t, t + 1.0) for t in range(5)], "k string, t int, x double"), "k", "t", "x", 2, 1).orderBy("t").collect()
    assert [r.x for r in lag] == [[1, 2], [2, 3], [3, 4]] and [r.y for r in lag] == [3, 4, 5]
    steps = spark.createDataFrame([("s", t, 0.0 if t < 20 else 3.0) for t in range(40)], "k string, t int, x double")
    assert timeseries.cusum(steps, "k", "t", "x", 2.0, direction="positive").orderBy("t").first().t >= 18


def test_alignment_leaves_wide_gaps_empty(spark):
    df = spark.createDataFrame([(c, t, t) for c in "ab" for t in (0.0, 0.1, 0.4)], "c string, t double, v double")
    rows = timeseries.aligned(df, "c", "t", "v", 10.0, 0.15).filter("c = 'a'").orderBy("t").collect()
    assert [r.value is None for r in rows] == [False, False, True, True, False]


def test_tokens(spark):
    from pyspark.sql import functions as F

    one = lambda s, f: spark.createDataFrame([(s,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one("  Hello   WORLD  ", text.normalized) == "hello world"
    assert len(one("Hi there. How are you? Fine!", text.sentences)) == 3
    assert one("Hello, world!", text.tokens) == ["hello", "world"]
    assert one("Ab c", text.characters) == ["a", "b", "c"]
    docs = spark.createDataFrame([(0, "The cat sat"), (1, "The dog sat"), (2, None)], "id int, t string")
    assert not {"the", "the cat"} & {r.term for r in text.terms(docs, "id", "t", 1, 2, ("the",)).collect()}


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "e")], "src string, dst string")
    found = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    dag = spark.createDataFrame([("fetch", "clean"), ("clean", "train"), ("train", "report")], "src string, dst string")
    assert {r.node: r.level for r in graph.topological_levels(dag).collect()} == {"fetch": 0, "clean": 1, "train": 2, "report": 3}
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_levels(edges)
    facts = spark.createDataFrame([("alice", "parent", "bob"), ("bob", "parent", "carol")], "s string, p string, o string")
    rule = ([("?x", "parent", "?y"), ("?y", "parent", "?z")], ("?x", "grandparent", "?z"))
    assert [tuple(r)[:3] for r in graph.infer(facts, [rule]).filter("derived").collect()] == [("alice", "grandparent", "carol")]
