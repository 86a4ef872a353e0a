"""Queries on fitted transformers: each learns from the line items shipped before 1996 and is applied to all."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import fitted as T
from quarry.plans.common import rounded, table

NUM = ["l_quantity", "l_extendedprice", "l_discount"]
KEY = ["l_orderkey", "l_linenumber"]


def _rows(spark, d):
    return table(spark, d, "lineitem").select(*KEY, *(F.col(c).cast("double").alias(c) for c in (*NUM, "l_tax")), "l_returnflag", "l_linestatus", F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("l_place"), "l_shipdate")


def _early(rows):
    return rows.filter("l_shipdate < '1996-01-01'")


def _applied(make, columns=tuple(NUM), label=None, digits=6):
    def query(spark, d):
        rows = _rows(spark, d)
        fit = make().fit(_early(rows), label)
        out = fit.transform(rows.select(*KEY, *columns))
        return rounded(out, digits)

    return query


def _inverse(spark, d):
    rows = _rows(spark, d).select(*KEY, *NUM)
    fit = T.StandardScaler(NUM).fit(_early(_rows(spark, d)))
    return rounded(fit.inverse_transform(fit.transform(rows)), 6)


def _codes_back(spark, d):
    rows = _rows(spark, d)
    fit = T.LabelEncoder("l_place").fit(_early(rows))
    codes = fit.transform(rows.select(*KEY, "l_place"))
    return fit.inverse_transform(codes).withColumnRenamed("l_place", "again")


def _columns(spark, d):
    rows = _rows(spark, d)
    blocks = [("std", T.StandardScaler(["l_quantity"])), ("range", T.MinMaxScaler(["l_extendedprice", "l_discount"])), ("flag", T.OneHotEncoder(["l_returnflag"], unknown="ignore"))]
    fit = T.ColumnTransformer(blocks, "passthrough", KEY).fit(_early(rows))
    return rounded(fit.transform(rows.select(*KEY, *NUM, "l_returnflag", "l_linestatus")), 6)


def _auto(spark, d):
    rows = _rows(spark, d).select(*KEY, "l_quantity", "l_returnflag", "l_shipdate")
    p = T.make_preprocessor(rows, numeric=["l_quantity"], categorical=["l_returnflag"], keys=KEY).fit(_early(rows))
    return rounded(p.transform(rows.drop("l_shipdate")), 6)


def _steps(spark, d):
    rows = _rows(spark, d)
    p = T.Pipeline([("fill", T.SimpleImputer(NUM, "median")), ("scale", T.MaxAbsScaler(NUM)), ("unit", T.Normalizer(NUM))]).fit(_early(rows))
    return rounded(p.transform(rows.select(*KEY, *NUM)), 6)


def _selected(make, label):
    def query(spark, d):
        rows = _rows(spark, d)
        fit = make().fit(rows, label)
        return spark.createDataFrame([(c, float(round(v, 3)), c in fit.names_out()) for c, v in fit.state.items()], "feature string, score double, kept boolean")

    return query


QUERIES = {
    "fit_standard": _applied(lambda: T.StandardScaler(NUM)), "fit_minmax": _applied(lambda: T.MinMaxScaler(NUM, -1.0, 1.0)), "fit_maxabs": _applied(lambda: T.MaxAbsScaler(NUM)), "fit_robust": _applied(lambda: T.RobustScaler(NUM)),
    "fit_inverse": _inverse, "fit_binarize": _applied(lambda: T.Binarizer(NUM, 5.0)), "fit_normalize": _applied(lambda: T.Normalizer(NUM, "l2")), "fit_normalize_l1": _applied(lambda: T.Normalizer(NUM, "l1")),
    "fit_kbins": _applied(lambda: T.KBinsDiscretizer(NUM, 4)), "fit_kbins_uniform": _applied(lambda: T.KBinsDiscretizer(NUM, 4, "uniform")), "fit_quantiles": _applied(lambda: T.QuantileTransform(["l_extendedprice"], 5), ("l_extendedprice",)),
    "fit_ordinal": _applied(lambda: T.OrdinalEncoder(["l_returnflag", "l_place"], -1), ("l_returnflag", "l_place")), "fit_label_inverse": _codes_back, "fit_one_hot": _applied(lambda: T.OneHotEncoder(["l_returnflag"], "first", "ignore"), ("l_returnflag",)),
    "fit_target": _applied(lambda: T.TargetEncoder(["l_place"], 2.0), ("l_place",), "l_quantity"), "fit_impute": _applied(lambda: T.SimpleImputer(NUM, "mean")), "fit_columns": _columns, "fit_preprocessor": _auto, "fit_pipeline": _steps,
    "fit_variance": _selected(lambda: T.VarianceThreshold(NUM + ["l_tax"], 0.001), None), "fit_select_anova": _selected(lambda: T.SelectKBest(NUM, 2), "l_returnflag"), "fit_select_correlation": _selected(lambda: T.SelectKBest(["l_quantity", "l_discount", "l_tax"], 1, T.correlation_f), "l_extendedprice"),
}

_K = "l_orderkey, l_linenumber"
_L = "WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax, l_returnflag, l_linestatus, concat('L', l_linenumber) AS l_place, l_shipdate FROM lineitem), e AS (SELECT * FROM l WHERE l_shipdate < '1996-01-01')"


def _sql(stats, value, columns=NUM):
    aggs = ", ".join(f"{s.format(c=c)} AS {k}_{c}" for c in columns for k, s in stats.items())
    return f"{_L}, s AS (SELECT {aggs or 'count(*) AS one'} FROM e) SELECT {_K}, " + ", ".join(f"round({value.format(c=c)}, 6) AS {c}" for c in columns) + " FROM l, s"


_count = lambda edges: " + ".join(f"CASE WHEN {{c}} >= {e} THEN 1 ELSE 0 END" for e in edges)
_size = "sqrt(l_quantity ^ 2 + l_extendedprice ^ 2 + l_discount ^ 2)"
_codes = lambda c: f"SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS k FROM (SELECT DISTINCT {c} FROM e)"
_f = lambda c: f"((sum(s{c} ^ 2 / n) - sum(s{c}) ^ 2 / sum(n)) / (count(*) - 1)) / ((sum(q{c}) - sum(s{c} ^ 2 / n)) / (sum(n) - count(*)))"
ORACLES = {
    "fit_standard": _sql({"m": "avg({c})", "d": "stddev_pop({c})"}, "({c} - m_{c}) / d_{c}"), "fit_minmax": _sql({"a": "min({c})", "b": "max({c})"}, "({c} - a_{c}) / (b_{c} - a_{c}) * 2 - 1"), "fit_maxabs": _sql({"a": "max(abs({c}))"}, "{c} / a_{c}"),
    "fit_robust": _sql({"q": "quantile_cont({c}, [0.25, 0.5, 0.75])"}, "({c} - q_{c}[2]) / (q_{c}[3] - q_{c}[1])"), "fit_inverse": _sql({}, "{c}"), "fit_binarize": _sql({}, "CASE WHEN {c} > 5 THEN 1.0 ELSE 0.0 END::DOUBLE"),
    "fit_normalize": _sql({}, "{c} / " + _size), "fit_normalize_l1": _sql({}, "{c} / (abs(l_quantity) + abs(l_extendedprice) + abs(l_discount))"), "fit_impute": _sql({}, "{c}"),
    "fit_kbins": _sql({"q": "quantile_cont({c}, [0.25, 0.5, 0.75])"}, _count([f"q_{{c}}[{k}]" for k in (1, 2, 3)])).replace("round(", "("). replace(", 6) AS", ") AS"),
    "fit_kbins_uniform": _sql({"a": "min({c})", "b": "max({c})"}, _count([f"a_{{c}} + {p} * (b_{{c}} - a_{{c}})" for p in (0.25, 0.5, 0.75)])).replace("round(", "(").replace(", 6) AS", ") AS"),
    "fit_quantiles": f"""{_L}, s AS (SELECT quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) AS q FROM e) SELECT {_K}, round(CASE WHEN l_extendedprice <= q[1] THEN 0 WHEN l_extendedprice >= q[5] THEN 1 WHEN l_extendedprice < q[2] THEN 0.25 * (l_extendedprice - q[1]) / (q[2] - q[1])
 WHEN l_extendedprice < q[3] THEN 0.25 + 0.25 * (l_extendedprice - q[2]) / (q[3] - q[2]) WHEN l_extendedprice < q[4] THEN 0.5 + 0.25 * (l_extendedprice - q[3]) / (q[4] - q[3]) ELSE 0.75 + 0.25 * (l_extendedprice - q[4]) / (q[5] - q[4]) END, 6)::DOUBLE AS l_extendedprice FROM l, s""",
    "fit_ordinal": f"{_L}, a AS ({_codes('l_returnflag')}), b AS ({_codes('l_place')}) SELECT {_K}, coalesce(a.k, -1) AS l_returnflag, coalesce(b.k, -1) AS l_place FROM l LEFT JOIN a ON l.l_returnflag = a.l_returnflag LEFT JOIN b ON l.l_place = b.l_place",
    "fit_label_inverse": f"{_L} SELECT {_K}, l_place AS again FROM l", "fit_one_hot": f"{_L} SELECT {_K}, CAST(l_returnflag = 'N' AS DOUBLE) AS \"l_returnflag_N\", CAST(l_returnflag = 'R' AS DOUBLE) AS \"l_returnflag_R\" FROM l",
    "fit_target": f"{_L}, m AS (SELECT avg(l_quantity) AS m FROM e), t AS (SELECT l_place AS k, sum(l_quantity) AS s, count(*) AS n FROM e GROUP BY 1) SELECT {_K}, round(coalesce((s + 2 * m) / (n + 2), m), 6) AS l_place FROM l LEFT JOIN t ON l_place = k, m",
    "fit_columns": f"""{_L}, s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, min(l_extendedprice) AS a, max(l_extendedprice) AS b, min(l_discount) AS f, max(l_discount) AS g FROM e) SELECT {_K}, round((l_quantity - m) / d, 6) AS std__l_quantity, round((l_extendedprice - a) / (b - a), 6) AS range__l_extendedprice,
 round((l_discount - f) / (g - f), 6) AS range__l_discount, CAST(l_returnflag = 'A' AS DOUBLE) AS "flag__l_returnflag_A", CAST(l_returnflag = 'N' AS DOUBLE) AS "flag__l_returnflag_N", CAST(l_returnflag = 'R' AS DOUBLE) AS "flag__l_returnflag_R", l_linestatus FROM l, s""",
    "fit_preprocessor": f"""{_L}, s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM e) SELECT {_K}, round((l_quantity - m) / d, 6) AS l_quantity, CAST(l_returnflag = 'A' AS DOUBLE) AS "l_returnflag_A", CAST(l_returnflag = 'N' AS DOUBLE) AS "l_returnflag_N", CAST(l_returnflag = 'R' AS DOUBLE) AS "l_returnflag_R" FROM l, s""",
    "fit_pipeline": f"{_L}, s AS (SELECT max(l_quantity) AS a, max(l_extendedprice) AS b, max(l_discount) AS c FROM e), u AS (SELECT *, l_quantity / a AS x, l_extendedprice / b AS y, l_discount / c AS z FROM l, s) SELECT {_K}, round(x / sqrt(x * x + y * y + z * z), 6) AS l_quantity, round(y / sqrt(x * x + y * y + z * z), 6) AS l_extendedprice, round(z / sqrt(x * x + y * y + z * z), 6) AS l_discount FROM u",
    "fit_variance": _L + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 3) AS score, var_pop({c}) > 0.001 AS kept FROM l" for c in NUM + ["l_tax"]),
    "fit_select_anova": f"{_L}, g AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS s0, sum(l_quantity ^ 2) AS q0, sum(l_extendedprice) AS s1, sum(l_extendedprice ^ 2) AS q1, sum(l_discount) AS s2, sum(l_discount ^ 2) AS q2 FROM l GROUP BY 1), f AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_f(k)} AS score FROM g" for k, c in enumerate(NUM)) + ") SELECT feature, round(score, 3) AS score, row_number() OVER (ORDER BY score DESC) <= 2 AS kept FROM f",
    "fit_select_correlation": f"{_L}, f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) ^ 2 / (1 - corr({c}, l_extendedprice) ^ 2) * (count(*) - 2) AS score FROM l" for c in ("l_quantity", "l_discount", "l_tax")) + ") SELECT feature, round(score, 3) AS score, row_number() OVER (ORDER BY score DESC) <= 1 AS kept FROM f",
}
