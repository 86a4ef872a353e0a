"""Metrics of predictions: classification, ranking, regression and calibration.

Each takes column names and returns one row (or a row a class or bin); all are partial
aggregates, so only counts are shuffled. Rows with a missing value in a used column
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _all():
    """A window over all rows, of tables with a row a class."""
    return Window.partitionBy(F.lit(1))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_matrix(df: DataFrame, y: str, p: str, normalize: str | None = None) -> DataFrame:
    """label, predicted, n for all pairs of labels seen in either column; normalize
    divides by the "true" or "pred" label's sum or by "all"."""
    rows = df.select(F.col(y).alias("label"), F.col(p).alias("predicted")).dropna()
    counts = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("label", "predicted")).alias("label")).distinct()
    # classes times classes, not rows
    grid = labels.crossJoin(labels.select(F.col("label").alias("predicted")))
    full = grid.join(counts, ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    if normalize is None:
        return full
    w = {"true": Window.partitionBy("label"), "pred": Window.partitionBy("predicted"), "all": _all()}[normalize]
    return full.withColumn("n", _ratio(F.col("n"), F.sum("n").over(w)))


def class_scores(df: DataFrame, y: str, p: str, beta: float = 1.0) -> DataFrame:
    """label, support, precision, recall, f, jaccard and specificity of each class."""
    counts = df.select(F.col(y).alias("y"), F.col(p).alias("p")).dropna().groupBy("y", "p").agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("q")), F.struct(F.col("p").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("q"))))
    per = counts.select(sides.alias("s"), "n", (F.col("y") == F.col("p")).alias("hit")).groupBy("s.label").agg(
        F.sum(F.col("n") * F.col("s.t")).alias("support"), F.sum(F.col("n") * F.col("s.q")).alias("found"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.t")).otherwise(0)).alias("tp"))
    per = per.withColumn("all", F.sum("support").over(_all()))
    precision, recall = _ratio(F.col("tp"), F.col("found")), _ratio(F.col("tp"), F.col("support"))
    b = beta * beta
    negatives = F.col("all") - F.col("support")
    return per.select(
        "label", "support", precision.alias("precision"), recall.alias("recall"), _ratio((1 + b) * precision * recall, b * precision + recall).alias("f"),
        _ratio(F.col("tp"), F.col("support") + F.col("found") - F.col("tp")).alias("jaccard"), _ratio(negatives - (F.col("found") - F.col("tp")), negatives).alias("specificity"))


def averaged_scores(df: DataFrame, y: str, p: str, average: str = "macro", beta: float = 1.0) -> DataFrame:
    """precision, recall, f, jaccard over all classes: macro, or weighted by support."""
    per = class_scores(df, y, p, beta)
    names = ("precision", "recall", "f", "jaccard")
    if average == "macro":
        return per.agg(*(F.avg(c).alias(c) for c in names))
    return per.agg(*(_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names))


def agreement(df: DataFrame, y: str, p: str) -> DataFrame:
    """accuracy, zero_one, balanced_accuracy, kappa and mcc, from class counts."""
    counts = df.select(F.col(y).alias("y"), F.col(p).alias("p")).dropna().groupBy("y", "p").agg(F.count("*").cast("double").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("t"), F.lit(0.0).alias("q")), F.struct(F.col("p").alias("label"), F.lit(0.0).alias("t"), F.col("n").alias("q"))))
    per = counts.select(sides.alias("s"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0.0).alias("h")).groupBy("s.label").agg(F.sum("s.t").alias("t"), F.sum("s.q").alias("q"), (F.sum("h") / 2).alias("h"))
    s = per.agg(F.sum("t").alias("n"), F.sum("h").alias("h"), F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.avg(F.when(F.col("t") > 0, F.col("h") / F.col("t"))).alias("balanced"))
    n, h, chance = F.col("n"), F.col("h"), F.col("tq") / (F.col("n") * F.col("n"))
    return s.select((h / n).alias("accuracy"), (1 - h / n).alias("zero_one"), F.col("balanced").alias("balanced_accuracy"), _ratio(h / n - chance, 1 - chance).alias("kappa"), _ratio(h * n - F.col("tq"), F.sqrt((n * n - F.col("qq")) * (n * n - F.col("tt")))).alias("mcc"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """The area under the ROC curve of a 0/1 label, ties averaged: rank sums over distinct scores."""
    counts = df.select(F.col(score).alias("s"), F.col(y).alias("y")).dropna().groupBy("s").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count("*").alias("n"))
    ranks = counts.withColumn("rank", F.sum("n").over(Window.orderBy("s")) - (F.col("n") - 1) / 2.0)
    sums = ranks.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"))
    return sums.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, id_col: str) -> DataFrame:
    """Sum of precision times gained recall over rows by descending score; ties aren't grouped, they go by id."""
    from quarry.operators.folds import numbered

    rows = numbered(df.select(id_col, F.col(y).alias("y"), F.col(score).alias("s")).dropna(), -F.col("s"), id_col)
    hits = numbered(rows.filter("y = 1").select(F.col("_row").alias("place")), "place", name="nth")
    return hits.agg((F.sum((F.col("nth") + 1) / (F.col("place") + 1)) / F.count("*")).alias("average_precision"))


def log_loss(df: DataFrame, y: str, prob: str, eps: float = 1e-12) -> DataFrame:
    """Of a 0/1 label and the probability of 1."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    return df.agg((-F.avg(F.when(F.col(y) == 1, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_loss"))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    """mae, mse, rmse, mape, smape, r2 and explained_variance in one pass."""
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).dropna()
    e = F.col("y") - F.col("p")
    s = rows.agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(1e-12))).alias("mape"), F.avg(2 * F.abs(e) / F.greatest(F.abs("y") + F.abs("p"), F.lit(1e-12))).alias("smape"),
        F.var_pop("y").alias("vy"), F.var_pop(e).alias("ve"))
    good = lambda x: F.when(F.col("vy") > 0, 1 - F.try_divide(x, F.col("vy"))).otherwise(0.0)
    return s.select("mae", "mse", F.sqrt("mse").alias("rmse"), "mape", "smape", good(F.col("mse")).alias("r2"), good(F.col("ve")).alias("explained_variance"))


def hinge_loss(df: DataFrame, y: str, decision: str) -> DataFrame:
    """Of labels above 0 or not and a decision value."""
    sign = F.when(F.col(y) > 0, 1.0).otherwise(-1.0)
    return df.agg(F.avg(F.greatest(F.lit(0.0), 1 - sign * F.col(decision))).alias("hinge_loss"))


def top_k_accuracy(df: DataFrame, y: str, scores: str, k: int = 2) -> DataFrame:
    """Share of rows whose label (a place in the array of scores) is among the k highest; ties to the smaller place."""
    own = F.element_at(F.col(scores), (F.col(y) + 1).cast("int"))
    above = F.size(F.filter(F.transform(F.col(scores), lambda s, i: (s > own) | ((s == own) & (i < F.col(y)))), lambda x: x))
    return df.agg(F.avg((above < k).cast("double")).alias("top_k_accuracy"))


def reliability_curve(df: DataFrame, y: str, prob: str, bins: int = 10) -> DataFrame:
    """bin, n, confidence and accuracy of equal-width bins, closed on the right."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col(prob) * bins) - 1)).cast("int")
    return df.select(F.col(y).alias("y"), F.col(prob).alias("p"), at.alias("bin")).dropna().groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg(F.col("y").cast("double")).alias("accuracy"))


def calibration(df: DataFrame, y: str, prob: str, bins: int = 10) -> DataFrame:
    """brier, ece and mce."""
    curve = reliability_curve(df, y, prob, bins)
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    errors = curve.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    return df.agg(F.avg((F.col(prob) - F.col(y)) * (F.col(prob) - F.col(y))).alias("brier")).crossJoin(errors)
