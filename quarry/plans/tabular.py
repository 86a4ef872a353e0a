"""Queries on the quality, drift, contracts and splits of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import contract, drift, folds, quality
from quarry.plans.common import rounded, table

NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def numeric_profile(spark, d):
    return rounded(quality.numeric_profile(table(spark, d, "lineitem"), NUM), 6)


def topk_values(spark, d):
    return quality.top_values(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], 3)


def rare_values(spark, d):
    return quality.rare_values(table(spark, d, "part"), ["p_brand", "p_type"], 0.05)


def categorical_profile(spark, d):
    return quality.categorical_profile(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


def duplicates(spark, d):
    return quality.duplicate_rows(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"])


def target_profile(spark, d):
    return rounded(quality.target_profile(table(spark, d, "labels"), "quality"), 9)


def _halves(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    early = F.col("l_shipdate") < "1996-01-01"
    return rows.filter(early).drop("l_shipdate"), rows.filter(~early).drop("l_shipdate")


def drift_psi(spark, d):
    a, b = _halves(spark, d)
    return rounded(drift.numeric_drift(a, b, "l_extendedprice").select("column", "missing_diff", "mean_diff", "std_diff", "psi"), 6)


def drift_tvd(spark, d):
    a, b = _halves(spark, d)
    return rounded(drift.categorical_drift(a, b, "l_returnflag").select("column", "missing_diff", "tvd", "unseen_rate"), 9)


def contract_violations(spark, d):
    c = contract.DataContract(rules={
        "c_acctbal": contract.Rule("numeric", low=0.0, high=9000.0), "c_mktsegment": contract.Rule(allowed=("BUILDING", "MACHINERY")), "c_nationkey": contract.Rule(unique=True), "c_name": contract.Rule(max_missing=0.1)}, required=("c_phone",))
    return c.validate(table(spark, d, "customer"))


def kfold(spark, d):
    return folds.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5).groupBy("fold").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def stratified_kfold(spark, d):
    rows = folds.stratified_kfold(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 3)
    return rows.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


def group_kfold(spark, d):
    rows = folds.group_kfold(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 4)
    per = rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("groups"))
    return per.agg(F.sum("n").alias("n"), F.sum("groups").alias("groups"), F.count("*").alias("folds"))


def time_series_split(spark, d):
    days = table(spark, d, "orders").select("o_orderkey")
    return folds.time_series_folds(days, "o_orderkey", 4, gap=10).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def train_test_split(spark, d):
    return folds.train_test_split(table(spark, d, "part").select("p_partkey"), "p_partkey", 0.3, seed=5).groupBy("part").agg(F.count("*").alias("n"))


QUERIES = {
    "quality_numeric_profile": numeric_profile, "quality_topk_values": topk_values, "quality_rare_values": rare_values, "quality_categorical_profile": categorical_profile, "duplicate_rows": duplicates, "target_profile": target_profile,
    "drift_psi": drift_psi, "drift_tvd": drift_tvd, "contract_violations": contract_violations, "kfold": kfold, "stratified_kfold": stratified_kfold, "group_kfold": group_kfold, "time_series_split": time_series_split, "train_test_split": train_test_split,
}

_PROFILE = """SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
 round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.75), 6) AS q75,
 (SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM lineitem) WHERE CASE WHEN a = b THEN {c} <> a ELSE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) END) AS outlier_count FROM lineitem"""
_TOP = "SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM {t} GROUP BY {c}"
ORACLES = {
    "quality_numeric_profile": " UNION ALL ".join(_PROFILE.format(c=c) for c in NUM),
    "quality_topk_values": "SELECT * FROM (" + " UNION ALL ".join(_TOP.format(c=c, t="orders") for c in ("o_orderpriority", "o_orderstatus")) + ") WHERE rank <= 3",
    "quality_rare_values": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM part GROUP BY {c} HAVING count(*) / (SELECT count(*) FROM part) < 0.05" for c in ("p_brand", "p_type")),
    "quality_categorical_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_count, count(DISTINCT {c}) <= 1 AS constant FROM lineitem" for c in ("l_returnflag", "l_linestatus")),
    "duplicate_rows": "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount)",
    "target_profile": "SELECT CAST(CAST(quality AS DOUBLE) AS VARCHAR) AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 9) AS share FROM labels GROUP BY quality",
    "drift_psi": """WITH h AS (SELECT l_extendedprice AS v, l_shipdate < '1996-01-01' AS e FROM lineitem), r AS (SELECT min(v) lo, max(v) hi FROM h WHERE e),
 b AS (SELECT e, least(CAST(floor((v - lo) / (hi - lo) * 10) AS INTEGER), 9) AS k FROM h, r WHERE v BETWEEN lo AND hi),
 c AS (SELECT k.k, 1.0 + count(*) FILTER (WHERE e) AS p, 1.0 + count(*) FILTER (WHERE NOT e) AS q FROM range(10) k(k) LEFT JOIN b ON b.k = k.k GROUP BY k.k),
 f AS (SELECT CAST(p AS DOUBLE) / sum(CAST(p AS DOUBLE)) OVER () AS p, CAST(q AS DOUBLE) / sum(CAST(q AS DOUBLE)) OVER () AS q FROM c)
 SELECT 'l_extendedprice' AS "column", 0.0::DOUBLE AS missing_diff, (SELECT round(avg(v) FILTER (WHERE NOT e) - avg(v) FILTER (WHERE e), 6) FROM h) AS mean_diff,
 (SELECT round(stddev_pop(v) FILTER (WHERE NOT e) - stddev_pop(v) FILTER (WHERE e), 6) FROM h) AS std_diff, round(sum((q - p) * ln(q / p)), 6) AS psi FROM f""",
    "drift_tvd": """WITH h AS (SELECT l_returnflag AS v, l_shipdate < '1996-01-01' AS e FROM lineitem),
 c AS (SELECT v, count(*) FILTER (WHERE e) AS p, count(*) FILTER (WHERE NOT e) AS q FROM h GROUP BY v), s AS (SELECT sum(p) AS sp, sum(q) AS sq FROM c)
 SELECT 'l_returnflag' AS "column", 0.0::DOUBLE AS missing_diff, round(0.5 * sum(abs(p / sp - q / sq)), 9) AS tvd, round(coalesce(sum(q) FILTER (WHERE p = 0), 0) / max(sq), 9) AS unseen_rate FROM c, s""",
    "contract_violations": """SELECT * FROM (SELECT 'missing_column' AS code, 'c_phone' AS "column", 'error' AS severity, 1.0::DOUBLE AS amount
 UNION ALL SELECT 'range_min', 'c_acctbal', 'error', count(*) FILTER (WHERE c_acctbal < 0)::DOUBLE FROM customer UNION ALL SELECT 'range_max', 'c_acctbal', 'error', count(*) FILTER (WHERE c_acctbal > 9000)::DOUBLE FROM customer
 UNION ALL SELECT 'allowed_values', 'c_mktsegment', 'error', count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))::DOUBLE FROM customer
 UNION ALL SELECT 'unique', 'c_nationkey', 'error', (count(c_nationkey) - count(DISTINCT c_nationkey))::DOUBLE FROM customer) WHERE amount > 0""",
    "kfold": "SELECT fold, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders) GROUP BY fold",
    "stratified_kfold": "SELECT o_orderstatus, fold, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM (SELECT o_orderkey, o_orderstatus, CAST(ntile(3) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders) GROUP BY ALL",
    "group_kfold": "SELECT count(*) AS n, count(DISTINCT c_nationkey) AS groups, CAST(4 AS BIGINT) AS folds FROM customer",
    "time_series_split": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders), f AS (SELECT CAST(k AS INTEGER) AS fold FROM range(4) t(k)),
 b AS (SELECT *, n // 5 AS size, n - (4 - fold) * (n // 5) AS start FROM r, f),
 p AS (SELECT fold, CASE WHEN rn >= start AND rn < start + size THEN 'test' WHEN rn < start - 10 THEN 'train' END AS part, o_orderkey FROM b)
 SELECT fold, part, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM p WHERE part IS NOT NULL GROUP BY fold, part""",
    "train_test_split": "SELECT 'test' AS part, CAST(ceil(count(*) * 0.3) AS BIGINT) AS n FROM part UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.3) AS BIGINT) FROM part",
}
