"""Time series: one row a series and time. Every operator takes the series' key and its
order column, and windows run within a series, so series are processed in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def lagged_matrix(df: DataFrame, key: str, order: str, value: str, lags: int = 1, horizon: int = 1) -> DataFrame:
    """key, order (of the first lag), x (array of lags values) and y, horizon after the last of them."""
    w = _w(key, order)
    frame = w.rowsBetween(0, lags - 1)
    rows = df.select(key, order, F.collect_list(value).over(frame).alias("x"), F.lead(value, lags + horizon - 1).over(w).alias("y"), F.count("*").over(w.rowsBetween(0, lags + horizon - 1)).alias("_n"))
    return rows.filter(F.col("_n") == lags + horizon).drop("_n")


def difference(df: DataFrame, key: str, order: str, value: str, periods: int = 1, times: int = 1) -> DataFrame:
    """key, order and the differences over periods, taken times times; heads have none."""
    rows = df.select(key, order, F.col(value).cast("double").alias("diff"))
    for _ in range(times):
        w = _w(key, order)
        rows = rows.select(key, order, (F.col("diff") - F.lag("diff", periods).over(w)).alias("diff"), F.row_number().over(w).alias("_n")).filter(F.col("_n") > periods).drop("_n")
    return rows


def rolling_mean(df: DataFrame, key: str, order: str, value: str, window: int) -> DataFrame:
    """Means of full windows, at the last row of each."""
    w = _w(key, order)
    rows = df.select(key, order, F.avg(value).over(w.rowsBetween(1 - window, 0)).alias("mean"), F.row_number().over(w).alias("_n"))
    return rows.filter(F.col("_n") >= window).drop("_n")


def autocorrelation(df: DataFrame, key: str, order: str, value: str, max_lag: int) -> DataFrame:
    """key, lag, acf for lags from 0: lagged products of deviations over the whole series' sum of squares."""
    centred = df.select(key, order, (F.col(value) - F.avg(value).over(Window.partitionBy(key))).alias("d"))
    w = _w(key, order)
    rows = centred.select(key, "d", *((F.col("d") * F.lag("d", k).over(w)).alias(f"p{k}") for k in range(1, max_lag + 1)))
    total = F.sum(F.col("d") * F.col("d"))
    sums = rows.groupBy(key).agg(F.array(F.lit(1.0), *(F.coalesce(F.try_divide(F.sum(f"p{k}"), total), F.lit(0.0)) for k in range(1, max_lag + 1))).alias("a"))
    return sums.select(key, F.posexplode("a").alias("lag", "acf"))


def partial_autocorrelation(df: DataFrame, key: str, order: str, value: str, max_lag: int) -> DataFrame:
    """key, lag, pacf by the Durbin-Levinson recursion, on arrays of one row a series."""
    acf = autocorrelation(df, key, order, value, max_lag).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("r"))

    def step(state: Column, k: Column) -> Column:
        phi, r = state["phi"], F.col("r")
        up = F.aggregate(F.transform(phi, lambda p, i: p * F.element_at(r, (k - i).cast("int"))), F.lit(0.0), lambda a, x: a + x)
        down = F.aggregate(F.transform(phi, lambda p, i: p * F.element_at(r, (i + 2).cast("int"))), F.lit(0.0), lambda a, x: a + x)
        new = F.coalesce(F.try_divide(F.element_at(r, (k + 1).cast("int")) - up, 1.0 - down), F.lit(0.0))
        turned = F.reverse(phi)
        return F.struct(F.concat(F.zip_with(phi, turned, lambda p, q: p - new * q), F.array(new)).alias("phi"), F.concat(state["out"], F.array(new)).alias("out"))

    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array(F.lit(1.0)).alias("out"))
    out = acf.select(key, F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), start, step, lambda s: s["out"]).alias("a"))
    return out.select(key, F.posexplode("a").alias("lag", "pacf"))


def exponential_smoothing(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.5) -> DataFrame:
    """key, order, smooth: alpha * x + (1 - alpha) * the last smooth, from the first x on.

    The recursion runs over each series' ordered array; a series must fit in a row.
    """
    lists = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("t"), F.col(value).cast("double").alias("x")))).alias("s"))
    empty = F.array().cast("array<double>")
    smooth = F.aggregate("s", empty, lambda acc, p: F.concat(acc, F.array(F.when(F.size(acc) == 0, p["x"]).otherwise(alpha * p["x"] + (1 - alpha) * F.try_element_at(acc, F.lit(-1))))))
    return lists.select(key, F.explode(F.zip_with("s", smooth, lambda p, m: F.struct(p["t"].alias(order), m.alias("smooth")))).alias("r")).select(key, "r.*")


def cusum(df: DataFrame, key: str, order: str, value: str, threshold: float = 5.0, drift: float = 0.0, direction: str = "both") -> DataFrame:
    """key, order of the change points: where a one-sided sum of deviations from the
    series' mean, less drift, passes the threshold; both sums then start anew."""
    lists = df.groupBy(key).agg(F.avg(value).alias("m"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("t"), F.col(value).cast("double").alias("x")))).alias("s"))
    up, down = direction in ("both", "positive"), direction in ("both", "negative")
    order_type = df.schema[order].dataType.simpleString()

    def step(a: Column, p: Column) -> Column:
        d = p["x"] - F.col("m")
        hi = F.greatest(F.lit(0.0), a["hi"] + d - drift) if up else F.lit(0.0)
        lo = F.greatest(F.lit(0.0), a["lo"] - d - drift) if down else F.lit(0.0)
        hit = (hi > threshold) | (lo > threshold)
        return F.struct(F.when(hit, 0.0).otherwise(hi).alias("hi"), F.when(hit, 0.0).otherwise(lo).alias("lo"), F.when(hit, F.concat(a["out"], F.array(p["t"]))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo"), F.array().cast(f"array<{order_type}>").alias("out"))
    return lists.select(key, F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias(order))


def resample(df: DataFrame, key: str, ts: str, value: str, every: str) -> DataFrame:
    """key, ts (start of each interval), n, total and mean."""
    return df.groupBy(key, F.window(ts, every).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(key, F.col("w.start").alias(ts), "n", "total", "mean")


def aligned(df: DataFrame, channel: str, t: str, value: str, rate: float, max_gap: float) -> DataFrame:
    """channel, t, value on one grid of all channels, linear between the samples around a
    grid time; null where these are further apart than max_gap.

    The grid spans the times that all channels cover. Of the samples between two grid
    times only the first and the last count, so an aggregate keeps these (of equal times
    the least and the greatest value) and windows run over grid times only.
    """
    at = F.col(t).cast("double")
    span = df.groupBy(channel).agg(F.min(at).alias("a"), F.max(at).alias("b")).agg(F.max("a").alias("a"), F.min("b").alias("b")).first()
    a, top = span["a"], -1 if span["a"] is None or span["b"] < span["a"] else int((span["b"] - span["a"]) * rate + 1e-9)
    start = F.lit(a).cast("double")
    time = lambda k: start + k / rate
    steps = df.sparkSession.range(top + 1).select(F.col("id").alias("k"))
    grid = df.select(F.col(channel).alias("_channel")).distinct().crossJoin(steps)
    # the last grid time not after a sample: rounding may put a quotient one off
    near = df.filter(at.isNotNull()).select(F.col(channel).alias("_channel"), F.struct(at.alias("t"), F.col(value).alias("v")).alias("s"), F.greatest(F.lit(-2), F.least(F.lit(top + 1), F.floor((at - start) * rate))).cast("long").alias("_k"))
    here = F.col("s.t")
    low = F.when(time(F.col("_k")) > here, F.col("_k") - 1).when(time(F.col("_k") + 1) <= here, F.col("_k") + 1).otherwise(F.col("_k"))
    cells = near.withColumn("_low", low).select("_channel", "s", F.least("_low", F.lit(top)).alias("low"), F.greatest(F.lit(0), F.when(time(F.col("_low")) == here, F.col("_low")).otherwise(F.col("_low") + 1)).alias("high"))
    ends = cells.groupBy("_channel", "low", "high").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    none = F.lit(None).cast(ends.schema["first"].dataType)
    rows = ends.filter(F.col("low") >= 0).select("_channel", F.col("low").alias("k"), none.alias("b"), F.col("first").alias("c"), F.lit(False).alias("g"))
    rows = rows.unionByName(ends.filter(F.col("high") <= top).select("_channel", F.col("high").alias("k"), F.col("last").alias("b"), none.alias("c"), F.lit(False).alias("g")))
    rows = rows.unionByName(grid.select("_channel", "k", none.alias("b"), none.alias("c"), F.lit(True).alias("g"))).groupBy("_channel", "k").agg(F.max("b").alias("b"), F.min("c").alias("c"), F.max("g").alias("g")).filter("g")
    before = F.last("b", ignorenulls=True).over(Window.partitionBy("_channel").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("c", ignorenulls=True).over(Window.partitionBy("_channel").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.select("_channel", time(F.col("k")).alias("_t"), before.alias("_b"), after.alias("_c"))
    gap = F.col("_c.t") - F.col("_b.t")
    between = F.when(gap == 0, F.col("_b.v")).otherwise(F.col("_b.v") + (F.col("_c.v") - F.col("_b.v")) * F.try_divide(F.col("_t") - F.col("_b.t"), gap))
    return found.select(F.col("_channel").alias(channel), F.col("_t").alias("t"), F.when(gap <= max_gap, between).alias("value"))


def forecast_errors(df: DataFrame, key: str, actual: str, predicted: str) -> DataFrame:
    """mae, mse, rmse and smape of each series."""
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(key).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(2 * F.abs(e) / F.greatest(F.abs(actual) + F.abs(predicted), F.lit(1e-12))).alias("smape"))


def ar1(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, intercept, phi of the autoregression of order one, by least squares."""
    rows = lagged_matrix(df, key, order, value, 1, 1).select(key, F.col("x")[0].cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.groupBy(key).agg(F.regr_slope("y", "x").alias("phi"), F.regr_intercept("y", "x").alias("intercept"))
