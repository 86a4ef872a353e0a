"""Transformers that are fitted on one table and applied to others.

fit() runs one aggregate (encoders: one grouping) and returns a fitted copy; transform()
is a projection with the learnt numbers as literals, or a join with the learnt
table of categories, so rows never reach the driver. Columns are replaced in place,
the others stay. Nulls and NaN take no part in a fit and stay null in a transform,
unless an imputer fills them.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.missing import present
from quarry.functions.quantiles import exact_quantiles


class NotFitted(ValueError):
    """transform() before fit()."""


class Transformer:
    """columns: those it reads and replaces; state: what fit() learnt."""

    def __init__(self, columns: Sequence[str]):
        self.columns, self.state = list(columns), None

    def learn(self, df: DataFrame):
        return {}

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit(self, df: DataFrame, label: str | None = None) -> Transformer:
        fitted = copy.copy(self)
        fitted.label = label
        fitted.state = fitted.learn(df)
        return fitted

    def transform(self, df: DataFrame) -> DataFrame:
        if self.state is None:
            raise NotFitted(type(self).__name__)
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing: {missing}")
        return self.apply(df)

    def fit_transform(self, df: DataFrame, label: str | None = None) -> DataFrame:
        return self.fit(df, label).transform(df)

    def names_out(self) -> list[str]:
        return self.columns


def _replaced(df: DataFrame, columns: Sequence[str], f: Callable[[str], Column]) -> DataFrame:
    return df.select(*(f(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def _one_row(df: DataFrame, columns: Sequence[str], **stats: Callable[[Column], Column]) -> dict[str, dict]:
    """Aggregates by column, from a single pass."""
    row = df.agg(*(f(present(df, c)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in stats.items())).first()
    return {c: {k: row[f"{k}_{i}"] for k in stats} for i, c in enumerate(columns)}


class _Affine(Transformer):
    """(x - shift) / scale + offset by column."""

    offset = 0.0

    def apply(self, df: DataFrame) -> DataFrame:
        return _replaced(df, self.columns, lambda c: (present(df, c) - F.lit(self.state[c][0])) / F.lit(self.state[c][1]) + F.lit(self.offset))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return _replaced(df, self.columns, lambda c: (F.col(c) - F.lit(self.offset)) * F.lit(self.state[c][1]) + F.lit(self.state[c][0]))


class StandardScaler(_Affine):
    """Mean 0 and population deviation 1; a constant column is only centred."""

    def learn(self, df):
        found = _one_row(df, self.columns, m=F.avg, s=F.stddev_pop)
        return {c: (float(x["m"] or 0.0), float(x["s"] or 1.0)) for c, x in found.items()}


class MinMaxScaler(_Affine):
    """The fitted range to low..high; a constant column becomes low."""

    def __init__(self, columns, low: float = 0.0, high: float = 1.0):
        super().__init__(columns)
        if not low < high:
            raise ValueError("low must be below high")
        self.offset, self.width = float(low), float(high - low)

    def learn(self, df):
        found = _one_row(df, self.columns, a=F.min, b=F.max)
        return {c: (float(x["a"] or 0.0), float((x["b"] or 0.0) - (x["a"] or 0.0) or 1.0) / self.width) for c, x in found.items()}


class MaxAbsScaler(_Affine):
    def learn(self, df):
        return {c: (0.0, float(x["m"] or 1.0)) for c, x in _one_row(df, self.columns, m=lambda v: F.max(F.abs(v))).items()}


class RobustScaler(_Affine):
    """Median 0 and the given range of exact percentiles 1."""

    def __init__(self, columns, low: float = 25.0, high: float = 75.0):
        super().__init__(columns)
        self.points = [low / 100, 0.5, high / 100]

    def learn(self, df):
        found = exact_quantiles(df, {c: (present(df, c), self.points) for c in self.columns})
        return {c: (float(q[1]), float(q[2] - q[0]) or 1.0) if q[0] is not None else (0.0, 1.0) for c, q in found.items()}


class SimpleImputer(Transformer):
    """"mean", "median", "most_frequent" (ties: the least value) or "constant"; a column without values gives 0."""

    def __init__(self, columns, strategy: str = "mean", fill=None):
        super().__init__(columns)
        if strategy not in ("mean", "median", "most_frequent", "constant"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.strategy, self.fill = strategy, fill

    def learn(self, df):
        if self.strategy == "constant":
            return dict.fromkeys(self.columns, self.fill)
        if self.strategy == "median":
            return {c: 0.0 if q[0] is None else q[0] for c, q in exact_quantiles(df, {c: (present(df, c), [0.5]) for c in self.columns}).items()}
        f = {"mean": F.avg, "most_frequent": lambda v: F.mode(v, True)}[self.strategy]
        return {c: 0.0 if x["v"] is None else x["v"] for c, x in _one_row(df, self.columns, v=f).items()}

    def apply(self, df):
        return _replaced(df, self.columns, lambda c: F.coalesce(present(df, c), F.lit(self.state[c])))


class KBinsDiscretizer(Transformer):
    """Bins of equal width ("uniform") or of equal counts ("quantile"), right-open, numbered from 0; values beyond the fitted range fall in the outer bins."""

    def __init__(self, columns, n_bins: int = 5, strategy: str = "quantile"):
        super().__init__(columns)
        if n_bins < 2 or strategy not in ("uniform", "quantile"):
            raise ValueError("two bins or more, uniform or quantile")
        self.n_bins, self.strategy = n_bins, strategy

    def learn(self, df):
        inner = [k / self.n_bins for k in range(1, self.n_bins)]
        if self.strategy == "uniform":
            found = _one_row(df, self.columns, a=F.min, b=F.max)
            return {c: [x["a"] + p * (x["b"] - x["a"]) for p in inner] if x["a"] is not None else [] for c, x in found.items()}
        found = exact_quantiles(df, {c: (present(df, c), inner) for c in self.columns})
        # equal edges would leave a bin without width
        return {c: list(accumulate([] if q[0] is None else q, lambda a, b: b if b > a else a + 1e-12)) for c, q in found.items()}

    def apply(self, df):
        count = lambda c: sum((F.when(F.col(c) >= F.lit(float(e)), 1).otherwise(0) for e in self.state[c]), F.lit(0))
        return _replaced(df, self.columns, lambda c: F.when(present(df, c).isNotNull(), count(c)))


class Binarizer(Transformer):
    """1 above the threshold, else 0."""

    def __init__(self, columns, threshold: float = 0.0):
        super().__init__(columns)
        self.threshold = threshold

    def apply(self, df):
        return _replaced(df, self.columns, lambda c: (present(df, c) > F.lit(float(self.threshold))).cast("double"))


class Normalizer(Transformer):
    """Rows of the columns to length 1 by "l1", "l2" or "max"; a row of zeros stays."""

    def __init__(self, columns, norm: str = "l2"):
        super().__init__(columns)
        if norm not in ("l1", "l2", "max"):
            raise ValueError(f"unknown norm {norm!r}")
        self.norm = norm

    def apply(self, df):
        own = [F.coalesce(present(df, c), F.lit(0.0)) for c in self.columns]
        size = {"l1": lambda: sum((F.abs(x) for x in own), F.lit(0.0)), "l2": lambda: F.sqrt(sum((x * x for x in own), F.lit(0.0))), "max": lambda: F.array_max(F.array(*map(F.abs, own)))}[self.norm]()
        return _replaced(df, self.columns, lambda c: present(df, c) / F.when(size > 0, size).otherwise(1.0))


class QuantileTransform(Transformer):
    """The share of fitted values at or under a value, straight between n quantiles (the
    mean from both sides of ties); beyond the range 0 and 1, a constant column 0.5."""

    def __init__(self, columns, n_quantiles: int = 1000, output: str = "uniform"):
        super().__init__(columns)
        self.points, self.output = [k / (n_quantiles - 1) for k in range(n_quantiles)], output

    def learn(self, df):
        found = _one_row(df, self.columns, q=lambda v: F.percentile(v, F.array(*map(F.lit, self.points))))
        return {c: [float(v) for v in x["q"] or [0.0, 0.0]] for c, x in found.items()}

    def apply(self, df):
        points, normal = self.points, self.output == "normal"

        def share(edges):
            @F.pandas_udf("double")
            def found(values):
                import numpy as np
                import pandas as pd

                x, q, p = values.to_numpy(float), np.array(edges), np.array(points[:len(edges)])
                if q[0] == q[-1]:
                    y = np.where(np.isnan(x), np.nan, 0.5)
                else:
                    y = (np.interp(x, q, p) - np.interp(-x, -q[::-1], -p[::-1])) / 2
                    y = np.where(x <= q[0], 0.0, np.where(x >= q[-1], 1.0, y))
                if normal:
                    from statistics import NormalDist

                    y = np.array([NormalDist().inv_cdf(min(max(v, 1e-7), 1 - 1e-7)) if v == v else v for v in y])
                return pd.Series(y).where(values.notna(), None)

            return found

        return _replaced(df, self.columns, lambda c: share(self.state[c])(present(df, c).cast("double")))


class OrdinalEncoder(Transformer):
    """Categories in order as 0, 1, ...; an unseen one is an error, or unknown (its value) where given. Nulls stay null."""

    def __init__(self, columns, unknown: int | None = None):
        super().__init__(columns)
        self.unknown = unknown

    def learn(self, df):
        from quarry.operators.folds import numbered

        out = {}
        for c in self.columns:
            kinds = df.select(F.col(c).alias("_value")).filter("_value IS NOT NULL").distinct()
            out[c] = numbered(kinds, "_value", name="_code")
        return out

    def apply(self, df):
        order = df.columns
        for c in self.columns:
            df = df.join(self.state[c], F.col(c) == F.col("_value"), "left")
            unseen = F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), F.col(c).cast("string"))) if self.unknown is None else F.lit(self.unknown).cast("long")
            df = df.withColumn("_code", F.when(F.col(c).isNull(), None).when(F.col("_code").isNull(), unseen).otherwise(F.col("_code")))
            df = df.select(*(F.col("_code").alias(c) if x == c else F.col(x) for x in order))
        return df

    def inverse_transform(self, df):
        order = df.columns
        for c in self.columns:
            df = df.join(self.state[c], F.col(c) == F.col("_code"), "left").select(*(F.col("_value").alias(c) if x == c else F.col(x) for x in order))
        return df


class LabelEncoder(OrdinalEncoder):
    """One column of classes, which must all be known."""

    def __init__(self, column: str):
        super().__init__([column])


class OneHotEncoder(Transformer):
    """A 0/1 column a category, in order: column_value. drop="first" leaves out the first;
    an unseen category is an error, or gives zeros with unknown="ignore". As each category is a
    column, a column of more than most categories is refused."""

    def __init__(self, columns, drop: str | None = None, unknown: str = "error", most: int = 1000):
        super().__init__(columns)
        self.drop, self.unknown, self.most = drop, unknown, most

    def learn(self, df):
        out = {}
        for c in self.columns:
            out[c] = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(self.most + 1).collect()]
            if len(out[c]) > self.most:
                raise ValueError(f"more than {self.most} categories in {c}")
        return out

    def _kept(self, c):
        return self.state[c][self.drop == "first":]

    def names_out(self):
        return [f"{c}_{v}" for c in self.columns for v in self._kept(c)]

    def apply(self, df):
        for c in self.columns:
            if self.unknown == "error":
                known = F.col(c).isin(self.state[c]) | F.col(c).isNull()
                df = df.withColumn(c, F.when(known, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), F.col(c).cast("string"))).cast(df.schema[c].dataType)))
        wide = [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for c in self.columns for v in self._kept(c)]
        return df.select(*(c for c in df.columns if c not in self.columns), *wide)


class TargetEncoder(Transformer):
    """(sum of the label + smoothing * mean) / (n + smoothing) of a category; unseen ones and nulls get the mean."""

    def __init__(self, columns, smoothing: float = 1.0):
        super().__init__(columns)
        self.smoothing = float(smoothing)

    def learn(self, df):
        mean = df.agg(F.avg(self.label)).first()[0] or 0.0
        score = (F.sum(self.label) + F.lit(self.smoothing * mean)) / (F.count(self.label) + F.lit(self.smoothing))
        return mean, {c: df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_value")).agg(score.alias("_score")) for c in self.columns}

    def apply(self, df):
        mean, tables = self.state
        order = df.columns
        for c in self.columns:
            df = df.join(tables[c], F.col(c) == F.col("_value"), "left").select(*(F.coalesce("_score", F.lit(mean)).alias(c) if x == c else F.col(x) for x in order))
        return df


class VarianceThreshold(Transformer):
    """Keeps columns whose population variance is above the threshold."""

    def __init__(self, columns, threshold: float = 0.0):
        super().__init__(columns)
        self.threshold = threshold

    def learn(self, df):
        return {c: float(x["v"] or 0.0) for c, x in _one_row(df, self.columns, v=F.var_pop).items()}

    def support(self) -> dict[str, bool]:
        return {c: v > self.threshold for c, v in self.state.items()}

    def names_out(self):
        return [c for c, kept in self.support().items() if kept]

    def apply(self, df):
        kept = self.support()
        return df.select(*(c for c in df.columns if kept.get(c, True)))


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> dict[str, float]:
    """F of a one-way analysis of variance by column: one grouping by class."""
    sums = [x for i, c in enumerate(columns) for x in (F.sum(c).alias(f"s{i}"), F.sum(F.col(c) * F.col(c)).alias(f"q{i}"))]
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *sums).collect()
    n, k, out = sum(r.n for r in rows), len(rows), {}
    for i, c in enumerate(columns):
        total, squares = sum(r[f"s{i}"] for r in rows), sum(r[f"q{i}"] for r in rows)
        within = squares - sum(r[f"s{i}"] ** 2 / r.n for r in rows)
        between = sum(r[f"s{i}"] ** 2 / r.n for r in rows) - total * total / n
        out[c] = float("inf") if within <= 0 else (between / max(k - 1, 1)) / (within / max(n - k, 1))
    return out


def correlation_f(df: DataFrame, columns: Sequence[str], label: str) -> dict[str, float]:
    """F of the squared correlation with a numeric label by column."""
    row = df.agg(F.count("*").alias("n"), *(F.corr(c, label).alias(f"r{i}") for i, c in enumerate(columns))).first()
    squared = {c: (row[f"r{i}"] or 0.0) ** 2 for i, c in enumerate(columns)}
    return {c: float("inf") if r >= 1 else r / (1 - r) * (row.n - 2) for c, r in squared.items()}


class SelectKBest(Transformer):
    """The k columns of the highest scores, in their order in the table; ties go to the earlier column."""

    def __init__(self, columns, k: int = 10, score: Callable = anova_f):
        super().__init__(columns)
        self.k, self.score = k, score

    def learn(self, df):
        return self.score(df, self.columns, self.label)

    def names_out(self):
        best = sorted(self.columns, key=lambda c: (-self.state[c], self.columns.index(c)))[:self.k]
        return [c for c in self.columns if c in best]

    def apply(self, df):
        kept = self.names_out()
        return df.select(*(c for c in df.columns if c not in self.columns or c in kept))


def importances(model, n: int) -> list[float]:
    """One number of 0 or more a feature, from a fitted model of pyspark.ml: its importances, or its absolute coefficients (summed over classes)."""
    if hasattr(model, "featureImportances"):
        return [float(x) for x in model.featureImportances.toArray()]
    if getattr(model, "numClasses", 2) > 2 and hasattr(model, "coefficientMatrix"):
        return [float(x) for x in abs(model.coefficientMatrix.toArray()).sum(axis=0)]
    if hasattr(model, "coefficients"):
        return [float(x) for x in abs(model.coefficients.toArray())]
    raise TypeError(f"{type(model).__name__} tells no importance of its {n} features")


def _fit_model(estimator, df: DataFrame, columns: Sequence[str], label: str):
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df.select(*columns, F.col(label).cast("double").alias("label")))
    return estimator.fit(rows), rows


class SelectFromModel(SelectKBest):
    """Columns whose importance in a fitted estimator of pyspark.ml reaches the threshold ("mean", "median" or a number), at most most of them."""

    def __init__(self, columns, estimator, threshold: str | float = "mean", most: int | None = None):
        super().__init__(columns, k=most or len(columns))
        self.estimator, self.threshold = estimator, threshold

    def learn(self, df):
        model, _ = _fit_model(self.estimator, df, self.columns, self.label)
        return dict(zip(self.columns, importances(model, len(self.columns))))

    def names_out(self):
        from statistics import median

        least = {"mean": lambda v: sum(v) / len(v), "median": median}[self.threshold](list(self.state.values())) if isinstance(self.threshold, str) else self.threshold
        return [c for c in super().names_out() if self.state[c] >= least]


class RFE(SelectKBest):
    """Refits without the step least important columns until keep are left; state: the rank by column, 1 for those kept."""

    def __init__(self, columns, estimator, keep: int | None = None, step: int = 1):
        super().__init__(columns, k=keep or max(1, len(columns) // 2))
        self.estimator, self.step = estimator, step

    def learn(self, df):
        left, gone = list(self.columns), []
        while len(left) > self.k:
            model, _ = _fit_model(self.estimator, df, left, self.label)
            weight = dict(zip(left, importances(model, len(left))))
            out = sorted(left, key=weight.get)[:min(self.step, len(left) - self.k)]
            gone.append(out)
            left = [c for c in left if c not in out]
        ranks = dict.fromkeys(left, 1)
        for k, out in enumerate(reversed(gone)):
            ranks |= dict.fromkeys(out, k + 2)
        return ranks

    def names_out(self):
        return [c for c in self.columns if self.state[c] == 1]


class SequentialFeatureSelector(SelectKBest):
    """Adds ("forward") or drops ("backward") the column that leaves the best score, until
    keep are left. score: of (fitted model, held-out rows); folds by a hash of the row."""

    def __init__(self, columns, estimator, score: Callable, keep: int | None = None, direction: str = "forward", folds: int = 3):
        super().__init__(columns, k=keep or max(1, len(columns) // 2))
        self.estimator, self.score_of, self.direction, self.folds = estimator, score, direction, folds

    def _value(self, df, columns):
        fold, total = F.pmod(F.xxhash64(*self.columns, self.label), F.lit(self.folds)), 0.0
        for k in range(self.folds):
            model, _ = _fit_model(self.estimator, df.filter(fold != k), columns, self.label)
            from pyspark.ml.feature import VectorAssembler

            held = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df.filter(fold == k).withColumn("label", F.col(self.label).cast("double")))
            total += self.score_of(model, held)
        return total / self.folds

    def learn(self, df):
        chosen = [] if self.direction == "forward" else list(self.columns)
        while len(chosen) != self.k:
            options = [chosen + [c] for c in self.columns if c not in chosen] if self.direction == "forward" else [[x for x in chosen if x != c] for c in chosen]
            chosen = max(options, key=lambda o: self._value(df, o))
        return {c: float(c in chosen) for c in self.columns}

    def names_out(self):
        return [c for c in self.columns if self.state[c]]


class ColumnTransformer:
    """Blocks (name, transformer) applied to their own columns of the same input; results
    are named name__column. remainder: "drop", or "passthrough" for the other columns. keys: columns that
    name a row; they stay first, and wider results are joined on them."""

    def __init__(self, blocks: Sequence[tuple[str, Transformer]], remainder: str = "drop", keys: Sequence[str] = ()):
        if remainder not in ("drop", "passthrough"):
            raise ValueError(f"unknown remainder {remainder!r}")
        self.blocks, self.remainder, self.keys = list(blocks), remainder, list(keys)

    def fit(self, df: DataFrame, label: str | None = None) -> ColumnTransformer:
        return ColumnTransformer([(n, t.fit(df, label)) for n, t in self.blocks], self.remainder, self.keys)

    def names_out(self) -> list[str]:
        return [f"{n}__{c}" for n, t in self.blocks for c in t.names_out()]

    def transform(self, df: DataFrame) -> DataFrame:
        used = {c for _, t in self.blocks for c in t.columns}
        rest = [c for c in df.columns if c not in used and c not in self.keys] if self.remainder == "passthrough" else []
        # each block works on copies of its columns, one projection after the other
        rows = df
        for n, t in self.blocks:
            own = rows.select("*", *(F.col(c).alias(f"_in_{c}") for c in t.columns))
            done = t.transform(own)
            rows = done.select(*(f"_in_{c}" for c in t.columns), *(c for c in done.columns if c not in t.names_out() and not c.startswith("_in_") and c not in t.columns), *(F.col(c).alias(f"{n}__{c}") for c in t.names_out()))
            rows = rows.select(*(F.col(c).alias(c[4:]) if c.startswith("_in_") else F.col(c) for c in rows.columns))
        return rows.select(*self.keys, *self.names_out(), *rest)

    def fit_transform(self, df: DataFrame, label: str | None = None) -> DataFrame:
        return self.fit(df, label).transform(df)


class Pipeline:
    """Steps (name, transformer) one after the other, each fitted on what the one before makes; the last may be an estimator of pyspark.ml on the assembled columns."""

    def __init__(self, steps: Sequence[tuple[str, object]], label: str | None = None):
        names = [n for n, _ in steps]
        if len(set(names)) < len(names) or any("__" in n for n in names):
            raise ValueError("names of steps must differ and hold no __")
        self.steps, self.label, self.model = list(steps), label, None

    def named_steps(self) -> dict[str, object]:
        return dict(self.steps)

    def set_params(self, **values) -> Pipeline:
        """step__attribute=value."""
        for name, value in values.items():
            step, _, attribute = name.partition("__")
            setattr(self.named_steps()[step], attribute, value)
        return self

    def get_params(self) -> dict[str, object]:
        return {f"{n}__{k}": v for n, s in self.steps for k, v in vars(s).items() if k != "state" and not k.startswith("_")}

    def _is_model(self, step) -> bool:
        return not hasattr(step, "transform")

    def fit(self, df: DataFrame, label: str | None = None) -> Pipeline:
        fitted, rows, label = [], df, label or self.label
        out = Pipeline([], label)
        for name, step in self.steps:
            if self._is_model(step):
                out.inputs = [c for c, t in rows.dtypes if c != label and t in ("int", "bigint", "double", "float")]
                out.model = _fit_model(step, rows, out.inputs, label)[0]
                break
            step = step.fit(rows, label)
            rows = step.transform(rows)
            fitted.append((name, step))
        out.steps = fitted
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step.transform(df)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        """The transformed rows with the model's prediction."""
        from pyspark.ml.feature import VectorAssembler

        if self.model is None:
            raise NotFitted("no model among the steps")
        rows = VectorAssembler(inputCols=self.inputs, outputCol="features", handleInvalid="keep").transform(self.transform(df))
        return self.model.transform(rows)

    def score(self, df: DataFrame) -> float:
        """Share of right predictions."""
        found = self.predict(df)
        return found.agg(F.avg((F.col("prediction") == F.col(self.label).cast("double")).cast("double"))).first()[0]


def make_preprocessor(df: DataFrame, *, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None, keys: Sequence[str] = (), scale: bool = True, remainder: str = "drop") -> Pipeline:
    """Numeric columns: median, then mean 0 and deviation 1; text columns: "missing" for
    nulls, then a column a category (zeros for unseen ones). Columns are taken from the schema
    where they aren't given."""
    free = [(c, t) for c, t in df.dtypes if c not in keys]
    numeric = list(numeric if numeric is not None else (c for c, t in free if t in ("int", "bigint", "double", "float") or t.startswith("decimal")))
    categorical = list(categorical if categorical is not None else (c for c, t in free if t == "string"))
    steps = [("median", SimpleImputer(numeric, "median"))] if numeric else []
    steps += [("scale", StandardScaler(numeric))] if numeric and scale else []
    steps += [("missing", SimpleImputer(categorical, "constant", "missing")), ("one_hot", OneHotEncoder(categorical, unknown="ignore"))] if categorical else []
    if remainder == "drop":
        steps.append(("columns", Columns([*keys, *numeric, *categorical])))
    return Pipeline(steps)


class Columns(Transformer):
    """Keeps the named columns and those made of them (name_value)."""

    def apply(self, df):
        return df.select(*(c for c in df.columns if c in self.columns or any(c.startswith(f"{x}_") for x in self.columns)))

    def transform(self, df):
        return self.apply(df)
