"""Column functions and fitted objects that SQL doesn't hold: against numpy, known values and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import distributions as D
from quarry.functions import neural as N
from quarry.functions import spectra as S
from quarry.functions import waves as W
from quarry.operators import anomaly, fitted, learners, relational


@pytest.fixture(scope="module")
def tone(spark):
    t = np.arange(256) / 64.0
    return spark.createDataFrame([(1, np.sin(2 * np.pi * 8 * t).tolist()), (2, (np.exp(-0.5 * t) * np.cos(2 * np.pi * 5 * t)).tolist()), (3, None)], "id long, x array<double>")


def one(df, column, k=1):
    return df.filter(F.col("id") == k).select(column.alias("y")).first().y


def test_spectra_of_a_tone(tone):
    x = np.array(one(tone, F.col("x")))
    assert one(tone, S.dominant_frequency("x", 64.0)) == pytest.approx(8.0)
    assert one(tone, S.dominant_frequency("x", 64.0), 3) is None
    assert np.allclose(one(tone, S.coherence("x", "x", 64.0, 64)), 1.0, atol=1e-6)
    assert np.allclose(one(tone, S.cross_spectrum("x", "x", 64.0, 64))["re"], one(tone, S.welch_psd("x", 64.0, 64)))
    assert np.sum(one(tone, S.periodogram("x", 64.0))) * 64 / 256 == pytest.approx(np.var(x), rel=1e-6)
    assert np.median(one(tone, S.instantaneous_frequency("x", 64.0))) == pytest.approx(8.0, abs=0.05)
    assert np.allclose(one(tone, S.envelope_demodulate("x", 64.0))[20:-20], 1.0, atol=0.05)
    kept, gone = one(tone, S.bandpass_filter("x", 6.0, 10.0, 64.0)), one(tone, S.notch_filter("x", 8.0, 4.0, 64.0))
    assert np.std(kept[60:-60]) > 0.6 > 0.2 > np.std(gone[60:-60])
    power = one(tone, S.wavelet_power(S.cwt("x", S.wavelet_scales(24, 2.0, 32.0))))
    scale = S.wavelet_scales(24, 2.0, 32.0)[int(np.mean(power, axis=1).argmax())]
    assert 6.0 * 64 / (2 * np.pi * scale) == pytest.approx(8.0, rel=0.15)
    assert len(set(one(tone, S.extract_ridge(S.wavelet_power(S.cwt("x", S.wavelet_scales(8, 2.0, 32.0)))))[40:-40])) == 1
    bank = S.mel_filter_bank(64.0, 64, 6)
    assert bank.shape == (6, 33) and (bank >= 0).all() and bank.max() <= 1
    mel = np.array(one(tone, S.mel_spectrogram("x", 64.0, 64, 32, n_mels=6)))
    assert np.allclose(np.log(np.maximum(mel, 1e-12)), one(tone, S.log_mel_spectrogram("x", 64.0, 64, 32, n_mels=6)))
    assert np.array(one(tone, S.mfcc("x", 64.0, 4, 6, 64, 32))).shape == (len(mel), 4)
    c = np.array(one(tone, S.real_cepstrum("x")))
    assert np.allclose(np.fft.rfft(c).real, np.log(np.maximum(np.abs(np.fft.rfft(x)), 1e-12)))


def test_parametric_spectra(tone):
    f, damping, amplitude = one(tone, S.prony("x", 2, 64.0), 2)[0]
    assert (abs(f), damping, amplitude) == (pytest.approx(5.0), pytest.approx(-0.5, abs=1e-6), pytest.approx(0.5, abs=1e-6))
    assert int(np.argmax(one(tone, S.ar_spectrum("x", 4, 64.0, 256)))) * 64 / 256 == pytest.approx(8.0, abs=0.5)
    assert len(one(tone, S.fit_ar("x", 4))) == 5


@pytest.mark.parametrize("kind,edges", [("lowpass", 10.0), ("highpass", 10.0), ("bandpass", (6.0, 12.0)), ("bandstop", (6.0, 12.0))])
def test_butterworth(kind, edges):
    b, a = S.butterworth(3, edges, 64.0, kind)
    f, m = S.magnitude_response(b, a, 4096, 64.0)
    for edge in np.atleast_1d(edges):
        assert m[np.abs(f - edge).argmin()] == pytest.approx(math.sqrt(0.5), abs=0.01)
    assert S.is_stable(a) and m.max() == pytest.approx(1.0, abs=1e-3) and S.verify_filter(b, a, 64.0)["stable"]
    assert len(S.pole_zero(b, a)[1]) == len(a) - 1 and np.isfinite(S.group_delay(b, a)[1]).all()
    with pytest.raises(ValueError):
        S.butterworth(2, 40.0, 64.0)


def test_noise_is_seeded_and_has_its_size(spark):
    df = spark.range(200).select(F.col("id"), F.array_repeat(F.lit(1.0), 50).alias("x"))
    for kind, scale, spread in (("gauss", 0.5, 0.5), ("uniform", 0.5, 0.5 / math.sqrt(3)), ("laplace", 0.5, 0.5 * math.sqrt(2)), ("jitter", 0.3, 0.3)):
        a, b = (np.array([r.y for r in df.repartition(n).orderBy("id").select(W.noise("x", kind, scale, 3, "id").alias("y")).collect()]) for n in (1, 5))
        assert np.array_equal(a, b) and a.std() == pytest.approx(spread, rel=0.06) and a.mean() == pytest.approx(1.0, abs=0.03)
    gone = np.array([r.y for r in df.select(W.noise("x", "dropout", 0.2, 3, "id").alias("y")).collect()])
    assert (gone == 0).mean() == pytest.approx(0.2, abs=0.02)
    assert sorted(one(df, W.shuffled("x", 1, "id"))) == [1.0] * 50


def test_distributions(spark):
    df = spark.range(20000).select("id", (F.col("id") / 1000 - 10).alias("x"))
    got = df.agg(F.max(F.abs(D.Normal().share("x") - 0.5 * (1 + D.erf(F.col("x") / math.sqrt(2)))))).first()[0]
    assert got < 1e-12
    for r in df.filter("id % 1999 = 0").select("x", D.erf("x").alias("e"), D.digamma(F.col("x") + 11).alias("d")).collect():
        assert r.e == pytest.approx(math.erf(r.x), abs=2e-7)
    assert df.limit(1).select(D.digamma(F.lit(1.0))).first()[0] == pytest.approx(-0.5772156649015329, abs=1e-9)
    for made in (D.Normal(3.0, 2.0), D.Uniform(-1.0, 5.0), D.Exponential(0.5), D.LogNormal(0.0, 0.5), D.Bernoulli(0.3)):
        row = df.select(made.draw("id", 5).alias("v")).agg(F.avg("v").alias("m"), F.var_pop("v").alias("v")).first()
        assert row.m == pytest.approx(made.mean, rel=0.05) and row.v == pytest.approx(made.variance, rel=0.1)
    assert D.Normal.fitted(df, "x").mean == pytest.approx(-0.0005)


@pytest.mark.parametrize("kind", ["sgd", "rmsprop", "adagrad", "adam", "adamw"])
def test_optimisers_reach_a_minimum(kind):
    p = np.array([3.0, -2.0])
    step = N.Optimizer([p], kind, 0.1 if kind != "adagrad" else 0.8, momentum=0.5)
    for _ in range(400):
        step.step([2 * (p - 1)])
    assert np.allclose(p, 1.0, atol=0.06)
    with pytest.raises(ValueError):
        N.Optimizer([p], "none")


def test_schedules():
    assert [N.step_lr(k, 1.0, 2, 0.5) for k in (0, 2, 5)] == [1.0, 0.5, 0.25] and N.cosine_lr(5, 1.0, 10) == pytest.approx(0.5)
    slow, stop = N.ReduceOnPlateau(1.0, 0.5, 1), N.EarlyStop(2)
    assert [slow(v) for v in (3, 2, 2, 2)] == [1.0, 1.0, 1.0, 0.5] and [stop(v) for v in (3, 2, 2, 2)] == [False, False, False, True]
    assert len(N.positions(3, 4)) == 3


def test_fitted_objects_refuse_what_they_dont_know(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 0.0), (2, None, "b", 1.0), (3, 5.0, None, 1.0), (4, float("nan"), "a", 0.0)], "id long, v double, k string, y double")
    with pytest.raises(fitted.NotFitted):
        fitted.StandardScaler(["v"]).transform(df)
    with pytest.raises(ValueError):
        fitted.StandardScaler(["v"]).fit(df).transform(df.drop("v"))
    new = spark.createDataFrame([(9, 3.0, "z", 0.0)], df.schema)
    with pytest.raises(Exception, match="unseen category"):
        fitted.LabelEncoder("k").fit(df).transform(new).collect()
    with pytest.raises(Exception, match="unseen category"):
        fitted.OneHotEncoder(["k"]).fit(df).transform(new).collect()
    assert fitted.SimpleImputer(["v"], "median").fit(df).transform(df).agg(F.sum("v")).first()[0] == 12.0
    empty = df.limit(0)
    for t in (fitted.StandardScaler(["v"]), fitted.MinMaxScaler(["v"]), fitted.RobustScaler(["v"]), fitted.KBinsDiscretizer(["v"]), fitted.SimpleImputer(["v"])):
        assert t.fit(empty).transform(df).count() == 4
    assert fitted.TargetEncoder(["k"]).fit(df, "y").transform(new).first().k == pytest.approx(0.5)


def test_selection_by_models(spark):
    from pyspark.ml.regression import LinearRegression

    rows = spark.range(300).select(F.col("id"), *((F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000).alias(c) for s, c in enumerate("abcd")))
    rows = rows.withColumn("y", 5 * F.col("b") + 2 * F.col("d"))
    names, model = list("abcd"), LinearRegression()
    assert fitted.RFE(names, model, 2).fit(rows, "y").names_out() == ["b", "d"]
    assert fitted.SelectFromModel(names, model).fit(rows, "y").names_out() == ["b", "d"]
    found = fitted.SequentialFeatureSelector(names, model, lambda m, held: -m.evaluate(held).meanSquaredError, 2, folds=2).fit(rows, "y")
    assert found.names_out() == ["b", "d"] and "a" not in found.transform(rows).columns


def test_pipeline_predicts(spark):
    from pyspark.ml.classification import LogisticRegression

    rows = spark.range(200).select(F.when(F.col("id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("v"), F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("k"), (F.col("id") % 2).cast("double").alias("y"))
    p = fitted.Pipeline([("scale", fitted.StandardScaler(["v"])), ("hot", fitted.OneHotEncoder(["k"])), ("model", LogisticRegression())], "y").fit(rows)
    assert p.score(rows) == 1.0 and "scale__columns" in fitted.Pipeline([("scale", fitted.StandardScaler(["v"]))]).get_params()
    with pytest.raises(ValueError):
        fitted.Pipeline([("a", fitted.Binarizer(["v"])), ("a", fitted.Binarizer(["v"]))])


def test_models_from_sums(spark):
    rows = spark.range(400).select((F.col("id") / 100).alias("x"), (3 + 2 * F.col("id") / 100 + F.when(F.col("id") % 10 == 0, 50.0).otherwise(0.0)).alias("y"))
    for found in (learners.huber(rows, ["x"], "y", 0.5), learners.quantile_regression(rows, ["x"], "y")):
        assert found["x"] == pytest.approx(2.0, abs=0.1) and found["intercept"] == pytest.approx(3.0, abs=0.3)
    p, gain = learners.solve_riccati([[1.0, 1.0], [0.0, 1.0]], [[0.0], [1.0]], np.eye(2), [[1.0]])
    a, b = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[0.0], [1.0]])
    assert np.allclose(p, np.eye(2) + a.T @ p @ a - a.T @ p @ b @ gain) and (np.abs(np.linalg.eigvals(a - b @ gain)) < 1).all()


def test_isolation_forest_finds_the_far_row(spark):
    rows = spark.range(500).select("id", *((F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000).alias(c) for s, c in enumerate("ab"))).unionByName(spark.createDataFrame([(999, 9.0, 9.0)], "id long, a double, b double"))
    fit = anomaly.IsolationForest(["a", "b"], 30).fit(rows)
    assert fit.score(rows).orderBy(F.desc("score")).first().id == 999
    assert anomaly.IsolationForest(["a"]).fit(rows.limit(0)).score(rows).count() == 501


def test_bootstrap_and_sketch(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 100).cast("double").alias("v"))
    got = [r.mean for r in relational.bootstrap_means(rows, "id", "v", 60, 1).collect()]
    assert np.mean(got) == pytest.approx(49.5, abs=0.3) and np.std(got) == pytest.approx(28.87 / math.sqrt(5000), rel=0.4)
    s = relational.sketch(rows, "v").first()
    assert s.distinct == pytest.approx(100, rel=0.05) and s.quartiles[1] == pytest.approx(49.5, abs=2)
    with pytest.raises(Exception, match="not in the table"):
        relational.lookup(rows, rows.filter("id > 5").select("id", F.lit(1).alias("w")), "id", "w", on_miss="error").collect()


def test_splits(spark):
    from quarry.operators import folds

    rows = spark.range(103).withColumn("v", F.col("id") * 2)
    got = folds.shuffle_split(rows, "id", 3, 0.1, 0.5, 7)
    assert {(r["split"], r.role): r.n for r in got.groupBy("split", "role").agg(F.countDistinct("id").alias("n")).collect()} == {(k, x): n for k in range(3) for x, n in (("test", 11), ("train", 51))}
    assert folds.repeated_kfold(rows, "id", 5, 2).groupBy("repeat", "fold").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (20, 21, 10)
    assert sorted(r.fold for r in folds.leave_one_out(rows, "id").collect()) == list(range(103))
    curve = folds.learning_curve(rows, "id", lambda p: p.agg(F.avg("v")).first()[0], lambda m, p: -abs(m - p.agg(F.avg("v")).first()[0]), (0.5, 1.0), 2)
    assert len(curve) == 2 and all(x["train"] == [0.0, 0.0] for x in curve)
    assert [x["test"] for x in folds.validation_curve(rows, "id", lambda p, v: v, lambda m, p: m, [1, 2], 2)] == [[1, 1], [2, 2]]
    drawn = folds.drawn_parameters({"a": [1, 2, 3], "b": [4, 5]}, 4, 1)
    assert len({tuple(sorted(d.items())) for d in drawn}) == 4 and len(folds.drawn_parameters({"a": [1, 2]}, 9)) == 2


def test_made_tables(spark):
    from quarry.sources import made

    b = made.blobs(spark, 900, [[0.0, 0.0], [10.0, -5.0], [3.0, 3.0]], 0.5, 1).groupBy("label").agg(F.avg(F.col("x")[0]).alias("a"), F.avg(F.col("x")[1]).alias("b")).orderBy("label").collect()
    assert [(round(r.a, 0), round(r.b, 0)) for r in b] == [(0, 0), (10, -5), (3, 3)]
    m = made.moons(spark, 101).filter("label = 0").agg(F.max(F.abs(F.col("x")[0] * F.col("x")[0] + F.col("x")[1] * F.col("x")[1] - 1))).first()[0]
    assert m < 1e-9 and made.classification(spark, 50, 4, 2).select(F.size("x")).distinct().collect()[0][0] == 4
    r = made.regression(spark, 2000, [2.0, -1.0]).select((F.col("y") - 2 * F.col("x")[0] + F.col("x")[1]).alias("d")).agg(F.max(F.abs("d"))).first()[0]
    assert r < 1e-9
    s = made.anomaly_series(spark, 400, 200).groupBy("changed").agg(F.avg("v").alias("m")).collect()
    assert len(s) == 2


def test_documents(spark, tmp_path):
    from quarry.sources import documents

    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (8.0, "a")], "v double, k string")
    for t in (fitted.StandardScaler(["v"]), fitted.KBinsDiscretizer(["v"], 2), fitted.OneHotEncoder(["k"]), fitted.SimpleImputer(["v"]), fitted.QuantileTransform(["v"], 3)):
        fit, path = t.fit(df), str(tmp_path / type(t).__name__)
        documents.save_model(fit, path)
        assert documents.load_model(path).transform(df).collect() == fit.transform(df).collect()
    with pytest.raises(TypeError):
        documents.save_model(fitted.OrdinalEncoder(["k"]).fit(df), str(tmp_path / "o"))
    robot = '<robot><joint name="j" type="revolute"><parent link="a"/><child link="b"/><origin xyz="0 0 1" rpy="0 0 0"/><axis xyz="0 0 1"/><limit lower="-1" upper="2"/></joint></robot>'
    r = documents.load_urdf(spark, robot).first()
    assert (r.joint, r.parent, r.child, r.xyz, r.axis, r.lower, r.upper) == ("j", "a", "b", [0.0, 0.0, 1.0], [0.0, 0.0, 1.0], -1.0, 2.0)
    with pytest.raises(ValueError):
        documents.load_urdf(spark, "<!DOCTYPE x><robot/>")
    assert documents.load_world(spark, '{"objects": [{"x": 1, "y": 2, "radius": 0.5}]}').first()[:] == ("circle", 1.0, 2.0, 0.5)


def test_alignments_and_checks(spark):
    from quarry.operators import comparisons as M

    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 2.0], [0.0, 0.0, 1.0, 2.0]), (2, [5.0], [1.0, 5.0])], "id long, x array<double>, y array<double>")
    assert one(df, M.dtw_distance("x", "y")) == 0.0 and one(df, M.dtw_distance("x", "y"), 2) == 4.0
    path = one(df, M.dtw_path("x", "y"))
    assert path[0] == [0.0, 0.0] and path[-1] == [3.0, 3.0]
    rows = spark.range(60).select((F.col("id") % 3).alias("a"), (F.col("id") % 3).cast("string").alias("b"), (F.col("id") % 4).alias("c"))
    assert M.adjusted_mutual_information(rows, "a", "b") == pytest.approx(1.0) and abs(M.adjusted_mutual_information(rows, "a", "c")) < 0.06
    assert M.kendall_tau(rows, "a", "a").first()[0] == 1.0 and M.check_matrix(rows, ["a", "c"], "b", "c") == 60
    for columns, label in ((["b"], None), ([], None), (["z"], None)):
        with pytest.raises(ValueError):
            M.check_matrix(rows, columns, label)
    with pytest.raises(ValueError, match="unusable"):
        M.check_matrix(rows.withColumn("d", F.when(F.col("a") > 0, F.col("a"))), ["d"])


def test_transforms_of_emphasised_signals(spark):
    x = spark.createDataFrame([(1, [3.0, -1.0, 0.5, 2.0]), (2, []), (3, None), (4, [5.0])], "id long, x array<double>")
    want = {1: [3.0, -1.0 - 0.97 * 3.0, 0.5 + 0.97, 2.0 - 0.97 * 0.5], 2: [], 3: None, 4: [5.0]}
    assert {r.id: r.y for r in x.select("id", W.pre_emphasis("x").alias("y")).collect()} == want
    back = x.select("id", S.de_emphasis(W.pre_emphasis("x")).alias("y"), F.size(S.fft_signal(W.pre_emphasis("x"))["re"]).alias("n")).filter("id in (1, 4)")
    assert {r.id: (r.y, r.n) for r in back.collect()} == {1: (pytest.approx([3.0, -1.0, 0.5, 2.0]), 4), 4: ([5.0], 1)}
