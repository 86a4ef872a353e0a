"""Queries on metrics, information and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import information, metrics, stats
from quarry.plans.common import rounded, table


def _li(spark, d):
    return table(spark, d, "lineitem")


def _scored(spark, d):
    """Line items with a 0/1 label and a score in steps of a hundredth."""
    return _li(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50.0).alias("s"), (F.col("l_discount") >= 0.05).cast("int").alias("p"))


def q(f, source=_li, digits=6):
    return lambda spark, d: rounded(f(source(spark, d)), digits)


QUERIES = {
    "confusion_matrix": q(lambda x: metrics.confusion_matrix(x, "y", "p"), _scored),
    "confusion_matrix_true": q(lambda x: metrics.confusion_matrix(x, "l_returnflag", "l_linestatus", "true")),
    "class_scores": q(lambda x: metrics.class_scores(x, "y", "p"), _scored),
    "fbeta_weighted": q(lambda x: metrics.averaged_scores(x, "y", "p", "weighted", 2.0), _scored),
    "agreement_scores": q(lambda x: metrics.agreement(x, "y", "p"), _scored),
    "roc_auc": q(lambda x: metrics.roc_auc(x, "y", "s"), _scored, 9),
    "average_precision": q(lambda x: metrics.average_precision(x.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).groupBy("id").agg(F.max("y").alias("y"), F.max("s").alias("s")), "y", "s", "id"), _scored),
    "log_loss": q(lambda x: metrics.log_loss(x, "y", "s"), _scored),
    "regression_metrics": q(lambda x: metrics.regression(x.withColumn("guess", F.col("l_quantity") * 1500.0), "l_extendedprice", "guess")),
    "hinge_loss": q(lambda x: metrics.hinge_loss(x.withColumn("m", F.col("s") - 0.5), "y", "m"), _scored),
    "reliability_curve": q(lambda x: metrics.reliability_curve(x, "y", "s"), _scored),
    "calibration_errors": q(lambda x: metrics.calibration(x, "y", "s"), _scored),
    "mutual_information": q(lambda x: information.mutual_information(x, "l_returnflag", "l_linestatus"), digits=9),
    "divergences": lambda spark, d: rounded(information.divergences(_li(spark, d).filter("l_linenumber <= 2"), _li(spark, d).filter("l_linenumber > 2"), "l_quantity"), 9),
    "partition_agreement": q(lambda x: information.partitions(x, "l_returnflag", "l_linenumber"), digits=9),
    "correlation": q(lambda x: stats.correlation(x, "l_quantity", "l_extendedprice"), digits=9),
    "mann_whitney": q(lambda x: stats.mann_whitney(x, "l_quantity", "l_returnflag", "A", "N").select("u", "z")),
    "wilcoxon": q(lambda x: stats.wilcoxon(x, "l_discount", "l_tax")),
    "kruskal": q(lambda x: stats.kruskal(x, "l_quantity", "l_returnflag")),
    "chi2_contingency": q(lambda x: stats.chi2_contingency(x, "l_returnflag", "l_linenumber")),
    "f_oneway": q(lambda x: stats.f_oneway(x, "l_extendedprice", "l_returnflag")),
    "iqr_outliers": q(lambda x: stats.outliers(x, "l_extendedprice", "iqr", 0.4).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"))),
    "zscore_outliers": q(lambda x: stats.outliers(x, "l_extendedprice", "zscore", 1.5).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("score").alias("top"))),
    "mod_zscore_outliers": q(lambda x: stats.outliers(x, "l_extendedprice", "mod_zscore", 1.2).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("score").alias("top"))),
    "ks_normal": q(lambda x: stats.ks_normal(x, "l_quantity", 25.0, 14.0), digits=8),
}

_S = "s AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity / 50.0 AS s, CAST(l_discount >= 0.05 AS INTEGER) AS p FROM lineitem)"
_RANK = "(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0)"
_MI = """h AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM j GROUP BY x)) AS hx, (SELECT -sum(n / t * ln(n / t)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM j GROUP BY y)) AS hy,
 (SELECT -sum(n / t * ln(n / t)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM j GROUP BY x, y)) AS hxy)"""
_SCORES = f"""{_S}, c AS (SELECT k AS label, count(*) FILTER (WHERE y = k) AS support, count(*) FILTER (WHERE p = k) AS found, count(*) FILTER (WHERE y = k AND p = k) AS tp, count(*) AS n FROM s, (VALUES (0), (1)) l(k) GROUP BY k),
 r AS (SELECT label, support, tp / found AS precision, tp / support AS recall, tp / (support + found - tp) AS jaccard, (n - support - found + tp) / (n - support) AS specificity FROM c)"""
ORACLES = {
    "confusion_matrix": f"WITH {_S} SELECT a.k AS label, b.k AS predicted, count(s.y) AS n FROM (VALUES (0), (1)) a(k) CROSS JOIN (VALUES (0), (1)) b(k) LEFT JOIN s ON s.y = a.k AND s.p = b.k GROUP BY 1, 2",
    "confusion_matrix_true": """WITH l AS (SELECT l_returnflag AS k FROM lineitem UNION SELECT l_linestatus FROM lineitem), c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2)
 SELECT x.k AS label, y.k AS predicted, round(coalesce(c.n / sum(c.n) OVER (PARTITION BY x.k), 0.0), 6)::DOUBLE AS n FROM l x CROSS JOIN l y LEFT JOIN c ON a = x.k AND b = y.k""",
    "class_scores": f"WITH {_SCORES} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f, round(jaccard, 6) AS jaccard, round(specificity, 6) AS specificity FROM r",
    "fbeta_weighted": f"WITH {_SCORES} SELECT round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(5 * precision * recall / (4 * precision + recall) * support) / sum(support), 6) AS f, round(sum(jaccard * support) / sum(support), 6) AS jaccard FROM r",
    "agreement_scores": f"""WITH {_S}, c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND p = 0)::DOUBLE AS tn, count(*) FILTER (WHERE y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND p = 0)::DOUBLE AS fn FROM s),
 e AS (SELECT *, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) AS pe FROM c)
 SELECT round((tp + tn) / n, 6) AS accuracy, round(1 - (tp + tn) / n, 6) AS zero_one, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(((tp + tn) / n - pe) / (1 - pe), 6) AS kappa, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM e""",
    "roc_auc": f"WITH {_S}, r AS (SELECT y, {_RANK.format(v='s')} AS rank FROM s) SELECT round((sum(rank) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9)::DOUBLE AS roc_auc FROM r",
    "average_precision": f"WITH {_S}, g AS (SELECT id, max(y) AS y, max(s) AS s FROM s GROUP BY id), o AS (SELECT y, row_number() OVER (ORDER BY s DESC, id) AS k, sum(y) OVER (ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING) AS h FROM g) SELECT round(avg(h / k) FILTER (WHERE y = 1), 6) AS average_precision FROM o",
    "log_loss": f"WITH {_S} SELECT round(-avg(CASE WHEN y = 1 THEN ln(least(greatest(s, 1e-12), 1 - 1e-12)) ELSE ln(1 - least(greatest(s, 1e-12), 1 - 1e-12)) END), 6) AS log_loss FROM s",
    "regression_metrics": """WITH r AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem), s AS (SELECT avg(abs(y - p)) AS mae, avg((y - p) ^ 2) AS mse, avg(abs(y - p) / greatest(abs(y), 1e-12)) AS mape, avg(2 * abs(y - p) / greatest(abs(y) + abs(p), 1e-12)) AS smape, var_pop(y) AS vy, var_pop(y - p) AS ve FROM r)
 SELECT round(mae, 6) AS mae, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(mape, 6) AS mape, round(smape, 6) AS smape, round(1 - mse / vy, 6) AS r2, round(1 - ve / vy, 6) AS explained_variance FROM s""",
    "hinge_loss": f"WITH {_S} SELECT round(avg(greatest(0.0, 1 - (CASE WHEN y > 0 THEN 1 ELSE -1 END) * (s - 0.5))), 6) AS hinge_loss FROM s",
    "reliability_curve": f"WITH {_S} SELECT CAST(greatest(0, least(9, ceil(s * 10) - 1)) AS INTEGER) AS bin, count(*) AS n, round(avg(s), 6) AS confidence, round(avg(y), 6) AS accuracy FROM s GROUP BY 1",
    "calibration_errors": f"WITH {_S}, b AS (SELECT greatest(0, least(9, ceil(s * 10) - 1)) AS bin, count(*) AS n, abs(avg(y) - avg(s)) AS gap FROM s GROUP BY 1) SELECT (SELECT round(avg((s - y) ^ 2), 6) FROM s) AS brier, round(sum(gap * n) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b",
    "mutual_information": f"""WITH j AS (SELECT l_returnflag AS x, l_linestatus AS y FROM lineitem), {_MI}
 SELECT round(hx, 9) AS entropy_x, round(hy, 9) AS entropy_y, round(hxy, 9) AS joint_entropy, round(hxy - hy, 9) AS conditional_entropy, round(hx + hy - hxy, 9) AS mutual_information, round((hx + hy - hxy) / sqrt(hx * hy), 9) AS nmi_sqrt,
 round((hx + hy - hxy) / ((hx + hy) / 2), 9) AS nmi_arithmetic, round((hx + hy - hxy) / greatest(hx, hy), 9) AS nmi_max, round((hx + hy - hxy) / least(hx, hy), 9) AS nmi_min, round(2 * hxy - hx - hy, 9) AS variation_of_information FROM h""",
    "divergences": """WITH c AS (SELECT l_quantity AS v, count(*) FILTER (WHERE l_linenumber <= 2)::DOUBLE AS p, count(*) FILTER (WHERE l_linenumber > 2)::DOUBLE AS q FROM lineitem GROUP BY 1), d AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM c)
 SELECT round(sum(-p * ln(greatest(q, 1e-12))), 9) AS cross_entropy, round(sum(CASE WHEN p > 0 THEN p * ln(p / greatest(q, 1e-12)) ELSE 0 END), 9) AS kl,
 round(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 9) AS js FROM d""",
    "partition_agreement": f"""WITH j AS (SELECT l_returnflag AS x, l_linenumber AS y FROM lineitem), {_MI}, p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM j GROUP BY x)) AS pa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM j GROUP BY y)) AS pb,
 (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM j GROUP BY x, y)) AS pab, (SELECT count(*) * (count(*) - 1.0) / 2 FROM j)::DOUBLE AS e), v AS (SELECT (hx + hy - hxy) / hx AS hom, (hx + hy - hxy) / hy AS com FROM h)
 SELECT round((pab - pa * pb / e) / ((pa + pb) / 2 - pa * pb / e), 9) AS adjusted_rand, round(hom, 9) AS homogeneity, round(com, 9) AS completeness, round(2 * hom * com / (hom + com), 9) AS v_measure FROM p, v""",
    "correlation": f"WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, {_RANK.format(v='l_quantity')}::DOUBLE AS rx, {_RANK.format(v='l_extendedprice')}::DOUBLE AS ry FROM lineitem) SELECT round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r",
    "mann_whitney": f"""WITH f AS (SELECT l_quantity AS v, l_returnflag AS g FROM lineitem WHERE l_returnflag IN ('A', 'N')), r AS (SELECT g, {_RANK.format(v='v')}::DOUBLE AS rank FROM f), t AS (SELECT sum(n ^ 3 - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM f GROUP BY v)),
 s AS (SELECT sum(rank) FILTER (WHERE g = 'A') AS r, count(*) FILTER (WHERE g = 'A')::DOUBLE AS n1, count(*) FILTER (WHERE g = 'N')::DOUBLE AS n2 FROM r), u AS (SELECT least(r - n1 * (n1 + 1) / 2, n1 * n2 - (r - n1 * (n1 + 1) / 2)) AS u, n1, n2 FROM s)
 SELECT round(u, 6) AS u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM u, t""",
    "wilcoxon": f"""WITH f AS (SELECT l_discount - l_tax AS d, abs(l_discount - l_tax) AS v FROM lineitem WHERE l_discount - l_tax <> 0), r AS (SELECT d, {_RANK.format(v='v')}::DOUBLE AS rank FROM f),
 s AS (SELECT least(sum(rank) FILTER (WHERE d > 0), sum(rank) FILTER (WHERE d < 0)) AS w, count(*) AS n FROM r) SELECT round(w, 6) AS w, n, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6)::DOUBLE AS z FROM s""",
    "kruskal": f"""WITH r AS (SELECT l_returnflag AS g, {_RANK.format(v='l_quantity')}::DOUBLE AS rank FROM lineitem), p AS (SELECT sum(rank) AS r, count(*)::DOUBLE AS n FROM r GROUP BY g), s AS (SELECT sum(r * r / n) AS rr, sum(n) AS n, count(*) - 1 AS df FROM p),
 t AS (SELECT sum(n ^ 3 - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_quantity)) SELECT round((12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - ties / (n ^ 3 - n)), 6) AS h, df FROM s, t""",
    "chi2_contingency": """WITH c AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT *, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x FROM c)
 SELECT round(sum((n - x) ^ 2 / x), 6) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM e""",
    "f_oneway": """WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1), a AS (SELECT avg(l_extendedprice) AS m FROM lineitem)
 SELECT round((sum(n * (g.m - a.m) ^ 2) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 6) AS f, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within FROM g, a""",
    "iqr_outliers": "SELECT l_returnflag, count(*) AS n, round(min(l_extendedprice), 6) AS low FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) WHERE l_extendedprice < a - 0.4 * (b - a) OR l_extendedprice > b + 0.4 * (b - a) GROUP BY 1",
    "zscore_outliers": "WITH z AS (SELECT l_returnflag, abs(l_extendedprice - m) / s AS score FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem)) SELECT l_returnflag, count(*) AS n, round(max(score), 6) AS top FROM z WHERE score > 1.5 GROUP BY 1",
    "mod_zscore_outliers": """WITH m AS (SELECT median(l_extendedprice) AS m FROM lineitem), d AS (SELECT median(abs(l_extendedprice - m)) AS d, any_value(m) AS m FROM lineitem, m), z AS (SELECT l_returnflag, 0.6745 * abs(l_extendedprice - m) / d AS score FROM lineitem, d)
 SELECT l_returnflag, count(*) AS n, round(max(score), 6) AS top FROM z WHERE score > 1.2 GROUP BY 1""",
}
