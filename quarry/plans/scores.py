"""Queries on images, unlike rows, models learnt from sums, bandits and linear systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import images as I
from quarry.operators import anomaly as A
from quarry.operators import comparisons as M
from quarry.operators import graph, neighbors
from quarry.operators import learners as L
from quarry.plans.common import rounded, table
from quarry.plans.waves import _d, _S, _x, digest

C = ["l_quantity", "l_extendedprice"]


def _rows(digits=6, **columns):
    return lambda spark, d: rounded(_x(spark, d).select("vec_id", I.shaped("x", 8).alias("m")).select("vec_id", *(f().alias(k) for k, f in columns.items())), digits)


def _grid(m):
    return digest(F.flatten(m))


def _li(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in (*C, "l_discount", "l_tax")), "l_returnflag")


def _coefficients(model):
    return lambda spark, d: rounded(spark.createDataFrame(list(model(_li(spark, d)).items()), "term string, coefficient double"), 3)


def _events(spark, d):
    return table(spark, d, "events")


def _qda(shared):
    def query(spark, d):
        rows = _li(spark, d)
        return L.discriminant_predict(rows, C, L.discriminant(rows, C, "l_returnflag", shared)).select("l_orderkey", "l_linenumber", "predicted")

    return query


def _knn_value(spark, d):
    e = table(spark, d, "embeddings")
    near = neighbors.neighbors(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return rounded(L.knn_regression(near, e.withColumn("v", F.col("embedding")[0].cast("double")), "vec_id", "v", "distance"), 6)


def _lof(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(A.local_outlier_factor(neighbors.neighbors(e, e, "vec_id", "embedding", 5)), 6)


def _forest(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(A.IsolationForest(["c_acctbal"], 20).fit(rows).score(rows), 6)


def _scc(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("src"), (F.col("o_orderkey") % 211).alias("dst"))
    return graph.strongly_connected_components(o).groupBy("component").agg(F.count("*").alias("n"))


def _schedule(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("task"), (F.col("n_regionkey") + 1.0).alias("duration"))
    edges = n.select(F.col("task").alias("src"), (F.col("task") * 2 + 1).alias("dst")).filter("dst < 25")
    return graph.schedule(n, edges)


QUERIES = {
    "img_basic": _rows(normal=lambda: _grid(I.normalize_image("m")), resized=lambda: _grid(I.resize_nearest("m", 4, 3)), integral=lambda: _grid(I.integral_image("m")), gray=lambda: _grid(I.rgb_to_gray(F.transform("m", lambda row: F.transform(row, lambda v: F.array(v, 2 * v, 3 * v)))))),
    "img_filters": _rows(blurred=lambda: _grid(I.box_blur("m")), edges=lambda: _grid(I.sobel_edges("m"))),
    "img_windows": _rows(windows=lambda: F.size(I.sliding_windows("m", 4, 2)).cast("long"), described=lambda: digest(I.patch_descriptor(I.sliding_windows("m", 4, 2)[4]["patch"])),
                         kept=lambda: F.size(I.non_max_suppression(F.array(*(F.array(*(F.lit(float(v)) for v in b)) for b in ((0, 0, 4, 4), (1, 1, 5, 5), (6, 6, 8, 8)))), F.array(F.col("m")[0][0], F.col("m")[0][1], F.col("m")[0][2]), 0.3)).cast("long")),
    "outlier_hbos": lambda s, d: rounded(A.HBOS(C, 5).fit(_li(s, d)).score(_li(s, d)).select("l_orderkey", "l_linenumber", "score"), 3), "outlier_envelope": lambda s, d: rounded(A.EllipticEnvelope(C).fit(_li(s, d)).score(_li(s, d)).select("l_orderkey", "l_linenumber", "score"), 5),
    "outlier_grubbs": lambda s, d: rounded(A.grubbs(_li(s, d), "l_extendedprice"), 6), "outlier_lof": _lof, "outlier_forest": _forest,
    "lin_ridgeless": _coefficients(lambda x: L.elastic_net(x, ["l_quantity", "l_discount"], "l_extendedprice", 0.0)), "lin_shrunk": _coefficients(lambda x: L.elastic_net(x, ["l_quantity"], "l_extendedprice", 10.0, 0.5)), "lin_lasso": _coefficients(lambda x: L.lasso(x, ["l_quantity"], "l_extendedprice", 100.0)),
    "lin_huber": _coefficients(lambda x: L.huber(x, ["l_quantity"], "l_extendedprice", 1e9)), "lin_predicted": lambda s, d: rounded(L.predicted(_li(s, d), {"intercept": 1.0, "l_quantity": 2.0, "l_discount": -3.0}).select("l_orderkey", "l_linenumber", "predicted"), 6),
    "nb_bernoulli": lambda s, d: rounded(L.bernoulli_nb(_li(s, d), C, "l_returnflag", 1.0, 25.0), 6), "nb_multinomial": lambda s, d: rounded(L.multinomial_nb(_li(s, d), C, "l_returnflag"), 6), "qda": _qda(False), "lda": _qda(True), "knn_regression": _knn_value,
    "vote": lambda s, d: L.voted(_li(s, d).select("l_orderkey", "l_linenumber", (F.col("l_quantity") % 3).alias("a"), (F.col("l_linenumber") % 3).cast("double").alias("b"), F.lit(1.0).alias("c")), ["a", "b", "c"]).select("l_orderkey", "l_linenumber", "predicted"),
    "bandit_ucb": lambda s, d: rounded(L.ucb(L.arms(_events(s, d), "event_type", "value")), 6), "bandit_softmax": lambda s, d: rounded(L.softmax_policy(L.arms(_events(s, d), "event_type", "value"), 5.0), 6), "bandit_greedy": lambda s, d: rounded(L.epsilon_greedy(L.arms(_events(s, d), "event_type", "value")), 6),
    "linucb": lambda s, d: L.linucb_score(_li(s, d), ["l_discount"], L.linucb(_li(s, d), "l_returnflag", ["l_discount"], "l_tax", 0.5)).groupBy("arm").agg(F.count("*").alias("n")),
    "kalman": lambda s, d: rounded(L.kalman(_events(s, d), "event_type", "event_id", "value"), 5), "pid": lambda s, d: rounded(L.pid(_events(s, d).select("event_type", "event_id", (F.col("value") - 50).alias("e")), "event_type", "event_id", "e", 0.5, 0.01, 0.1).select("event_id", "control"), 5),
    "label_scores": lambda s, d: rounded(M.label_scores(table(s, d, "labels"), "quality", "toxic"), 6), "kendall_tau": lambda s, d: rounded(M.kendall_tau(_li(s, d).withColumn("q", F.floor(F.col("l_quantity") / 10)), "l_linenumber", "q"), 6),
    "array_distances": lambda s, d: rounded(_x(s, d).select("vec_id", M.mahalanobis(F.slice("x", 1, 2), F.slice("x", 3, 2), [[2.0, 0.5], [0.5, 1.0]]).alias("mahalanobis"), M.wasserstein("x", F.transform("x", lambda v: 2 * v + 1)).alias("wasserstein")), 6),
    "adjusted_mi": lambda s, d: s.createDataFrame([(round(M.adjusted_mutual_information(_li(s, d), "l_returnflag", "l_linenumber"), 6),)], "ami double"),
    "dtw": lambda s, d: rounded(_x(s, d).select("vec_id", M.dtw_distance(F.slice("x", 1, 12), F.slice("x", 13, 12), 4).alias("distance")), 6),
    "scc": _scc, "schedule": _schedule, "dot": lambda s, d: graph.to_dot(table(s, d, "nation").select(F.col("n_name").alias("src"), F.col("n_regionkey").alias("dst"))),
}
_K = "l_orderkey, l_linenumber"
_cell = lambda r, c: f"x[greatest(0, least(7, {r})) * 8 + greatest(0, least(7, {c})) + 1]"
_I = "l AS (SELECT *, row_number() OVER () AS rid FROM lineitem)"
_all = "range(0, 64)"
_at = lambda dr, dc: _cell(f"i // 8 + {dr}", f"i % 8 + {dc}")
_gx = f"({_at(-1, 1)} - {_at(-1, -1)} + 2 * {_at(0, 1)} - 2 * {_at(0, -1)} + {_at(1, 1)} - {_at(1, -1)})"
_gy = f"({_at(1, -1)} - {_at(-1, -1)} + 2 * {_at(1, 0)} - 2 * {_at(-1, 0)} + {_at(1, 1)} - {_at(-1, 1)})"
_P = "p AS (SELECT a.vec_id AS query, b.vec_id AS id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ^ 2))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"
_hb = lambda c: f"(SELECT g.rid, g.l_orderkey, g.l_linenumber, -ln(greatest(n.n, 0.5) / (SELECT count(*) FROM lineitem) / w) AS s FROM g_{c} g JOIN n_{c} n USING (k))"
_bins = lambda c: f"e_{c} AS (SELECT min({c})::DOUBLE AS a, max({c})::DOUBLE AS b, (max({c}) - min({c}))::DOUBLE / 5 AS w FROM lineitem), g_{c} AS (SELECT rid, {_K}, w, CASE WHEN {c} = b THEN 4 ELSE least(4, floor(({c} - a) / w)) END AS k FROM l, e_{c}), n_{c} AS (SELECT k, count(*) AS n FROM g_{c} GROUP BY 1)"
_two = "avg(l_quantity) AS m1, avg(l_extendedprice) AS m2, var_pop(l_quantity) AS v1, var_pop(l_extendedprice) AS v2, covar_pop(l_quantity, l_extendedprice) AS c"
_far = "((l_quantity - m1) ^ 2 * v2 - 2 * (l_quantity - m1) * (l_extendedprice - m2) * c + (l_extendedprice - m2) ^ 2 * v1) / (v1 * v2 - c * c)"
_arms = "WITH a AS (SELECT event_type AS arm, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1)"
ORACLES = {
    "img_basic": f"""{_S} SELECT vec_id, round({_d('list_transform(x, lambda v: (v - list_min(x)) / (list_max(x) - list_min(x)))')}, 6) AS normal, round({_d('list_transform(range(0, 12), lambda i: x[(i // 3) * 2 * 8 + CAST(floor((i % 3) * 8 / 3.0) AS INT) + 1])')}, 6) AS resized,
 round({_d(f'list_transform({_all}, lambda i: list_sum(list_transform(list_filter({_all}, lambda j: j // 8 <= i // 8 AND j % 8 <= i % 8), lambda j: x[j + 1])))')}, 6) AS integral, round({_d('x')} * (0.299 + 2 * 0.587 + 3 * 0.114), 6) AS gray FROM t""",
    "img_filters": f"""{_S} SELECT vec_id, round({_d(f"list_transform({_all}, lambda i: ({' + '.join(_at(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))}) / 9)")}, 6) AS blurred, round({_d(f'list_transform({_all}, lambda i: sqrt({_gx} ^ 2 + {_gy} ^ 2))')}, 6) AS edges FROM t""",
    "img_windows": f"""{_S}, p AS (SELECT *, list_transform(range(0, 16), lambda i: x[(2 + i // 4) * 8 + 2 + i % 4 + 1]) AS p FROM t), c AS (SELECT *, list_transform(p, lambda v: v - list_avg(p)) AS c FROM p)
 SELECT vec_id, CAST(9 AS BIGINT) AS windows, round({_d('list_transform(c, lambda v: v / sqrt(list_sum(list_transform(c, lambda u: u * u))))')}, 6) AS described, CAST(2 AS BIGINT) AS kept FROM c""",
    "outlier_hbos": f"WITH {_I}, {_bins(C[0])}, {_bins(C[1])}, u AS (SELECT * FROM {_hb(C[0])} UNION ALL SELECT * FROM {_hb(C[1])}) SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, round(sum(s), 3) AS score FROM u GROUP BY rid",
    "outlier_envelope": f"WITH s AS (SELECT {_two} FROM lineitem) SELECT {_K}, round({_far}, 5) AS score FROM lineitem, s",
    "outlier_grubbs": "WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d, count(*) AS n FROM lineitem) SELECT l_extendedprice AS value, round(abs(l_extendedprice - m) / d, 6) AS g, n FROM lineitem, s ORDER BY g DESC, value DESC LIMIT 1",
    "outlier_lof": f"WITH {_P}), n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, id) <= 5), k AS (SELECT query AS id, max(d) AS kd FROM n GROUP BY 1), r AS (SELECT query, count(*) / sum(greatest(d, kd)) AS l FROM n JOIN k USING (id) GROUP BY 1) SELECT n.query AS id, round(avg(o.l) / any_value(r.l), 6) AS lof FROM n JOIN r ON r.query = n.query JOIN r o ON o.query = n.id GROUP BY 1",
    "lin_shrunk": "WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v, avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem), b AS (SELECT *, sign(c) * greatest(abs(c) - 5, 0) / (v + 5) AS b FROM s) SELECT 'intercept' AS term, round(y - b * x, 3) AS coefficient FROM b UNION ALL SELECT 'l_quantity', round(b, 3) FROM b",
    "lin_lasso": "WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v, avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem), b AS (SELECT *, sign(c) * greatest(abs(c) - 100, 0) / v AS b FROM s) SELECT 'intercept' AS term, round(y - b * x, 3) AS coefficient FROM b UNION ALL SELECT 'l_quantity', round(b, 3) FROM b",
    "lin_huber": "SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS coefficient FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem",
    "lin_predicted": f"SELECT {_K}, round(1 + 2 * l_quantity - 3 * l_discount, 6) AS predicted FROM lineitem",
    "nb_bernoulli": "SELECT l_returnflag AS label, count(*) AS n, " + ", ".join(f"round((count(*) FILTER (WHERE {c} > 25) + 1) / (count(*) + 2.0), 6)::DOUBLE AS p_{c}" for c in C) + " FROM lineitem GROUP BY 1",
    "nb_multinomial": "SELECT l_returnflag AS label, count(*) AS n, " + ", ".join(f"round(ln((sum({c}) + 1) / (sum(l_quantity) + sum(l_extendedprice) + 2)), 6) AS log_{c}" for c in C) + " FROM lineitem GROUP BY 1",
    "qda": f"WITH {_I}, s AS (SELECT l_returnflag AS f, count(*) AS n, {_two} FROM lineitem GROUP BY 1) SELECT {_K}, f AS predicted FROM l, s QUALIFY row_number() OVER (PARTITION BY rid ORDER BY ln(n) - 0.5 * ln(v1 * v2 - c * c) - 0.5 * {_far} DESC, f DESC) = 1",
    "lda": f"WITH {_I}, g AS (SELECT l_returnflag AS f, count(*) AS n, {_two} FROM lineitem GROUP BY 1), w AS (SELECT sum(n * v1) / sum(n) AS v1, sum(n * v2) / sum(n) AS v2, sum(n * c) / sum(n) AS c FROM g), s AS (SELECT f, n, m1, m2, w.* FROM g, w) SELECT {_K}, f AS predicted FROM l, s QUALIFY row_number() OVER (PARTITION BY rid ORDER BY ln(n) - 0.5 * {_far} DESC, f DESC) = 1",
    "knn_regression": f"WITH {_P} WHERE a.vec_id % 20 = 0), n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, id) <= 5) SELECT query, round(sum(embedding[1]::DOUBLE / greatest(d, 1e-12)) / sum(1 / greatest(d, 1e-12)), 6) AS predicted FROM n JOIN embeddings ON vec_id = id GROUP BY 1",
    "vote": f"WITH {_I}, v AS (SELECT rid, {_K}, unnest([l_quantity % 3, (l_linenumber % 3)::DOUBLE, 1.0]) AS v FROM l), c AS (SELECT rid, {_K}, v, count(*) AS n FROM v GROUP BY ALL) SELECT {_K}, v AS predicted FROM c QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n DESC, v) = 1",
    "bandit_ucb": f"{_arms} SELECT arm, n, round(mean, 6) AS mean, round(mean + sqrt(2 * ln(sum(n) OVER ()) / n), 6) AS score FROM a", "bandit_softmax": f"{_arms} SELECT arm, n, round(mean, 6) AS mean, round(exp(mean / 5) / sum(exp(mean / 5)) OVER (), 6) AS chance FROM a",
    "bandit_greedy": f"{_arms} SELECT arm, n, round(mean, 6) AS mean, round(0.1 / count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY mean DESC, arm) = 1 THEN 0.9 ELSE 0 END, 6)::DOUBLE AS chance FROM a",
    "linucb": f"WITH {_I}, s AS (SELECT l_returnflag AS f, 1 / (1 + sum(l_discount ^ 2)) AS i, sum(l_discount * l_tax) AS b FROM lineitem GROUP BY 1), p AS (SELECT f, row_number() OVER (PARTITION BY rid ORDER BY i * b * l_discount + 0.5 * sqrt(i * l_discount ^ 2) DESC, f DESC) AS r FROM l, s) SELECT f AS arm, count(*) AS n FROM p WHERE r = 1 GROUP BY 1",
    "kalman": """WITH RECURSIVE o AS (SELECT event_type, event_id, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), r AS (SELECT event_type, event_id, k, v AS m, CAST(1 AS DOUBLE) AS p FROM o WHERE k = 1
 UNION ALL SELECT o.event_type, o.event_id, o.k, r.m + (r.p + 0.01) / (r.p + 1.01) * (o.v - r.m), (r.p + 0.01) / (r.p + 1.01) FROM r JOIN o ON o.event_type = r.event_type AND o.k = r.k + 1) SELECT event_type, event_id, round(m, 5) AS estimate, round(p, 5) AS variance FROM r""",
    "pid": "WITH e AS (SELECT event_type, event_id, value - 50 AS e FROM events) SELECT event_id, round(0.5 * e + 0.01 * sum(e) OVER (w ROWS UNBOUNDED PRECEDING) + 0.1 * coalesce(e - lag(e) OVER w, 0), 5) AS control FROM e WINDOW w AS (PARTITION BY event_type ORDER BY event_id)",
    "label_scores": "SELECT round(count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) / count(*) FILTER (WHERE quality <> 1), 6)::DOUBLE AS specificity, round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / count(*) FILTER (WHERE quality = 1 OR toxic = 1), 6)::DOUBLE AS jaccard, round(avg((quality <> toxic)::INT), 6) AS zero_one_loss, count(*) FILTER (WHERE quality <> toxic) AS misses FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "kendall_tau": "WITH c AS (SELECT l_linenumber AS a, floor(l_quantity / 10) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT sum(x.n * y.n) FILTER (WHERE x.b < y.b) AS u, sum(x.n * y.n) FILTER (WHERE x.b > y.b) AS d FROM c x JOIN c y ON x.a < y.a) SELECT round((u - d)::DOUBLE / (u + d)::DOUBLE, 6) AS tau FROM p",
    "array_distances": f"{_S} SELECT vec_id, round(sqrt(2 * (x[1] - x[3]) ^ 2 + (x[1] - x[3]) * (x[2] - x[4]) + (x[2] - x[4]) ^ 2), 6) AS mahalanobis, round(list_avg(list_transform(list_sort(x), lambda v: abs(v + 1))), 6) AS wasserstein FROM t",
    "scc": "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 200 AS a, o_orderkey % 211 AS b FROM orders WHERE o_custkey % 200 <> o_orderkey % 211), n AS (SELECT o_custkey % 200 AS x FROM orders UNION SELECT o_orderkey % 211 FROM orders), r AS (SELECT x AS a, x AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT p.a AS node, max(p.b) AS component FROM r p JOIN r q ON p.a = q.b AND p.b = q.a GROUP BY 1) SELECT component, count(*) AS n FROM c GROUP BY 1",
    "schedule": "WITH RECURSIVE t AS (SELECT CAST(n_nationkey AS BIGINT) AS task, CAST(n_regionkey + 1 AS DOUBLE) AS d FROM nation), r AS (SELECT task, d, CAST(0 AS DOUBLE) AS start FROM t WHERE task % 2 = 0 UNION ALL SELECT t.task, t.d, r.start + r.d FROM r JOIN t ON t.task = r.task * 2 + 1) SELECT task, max(start)::DOUBLE AS start, max(start + d)::DOUBLE AS \"end\" FROM r GROUP BY 1",
    "dot": """SELECT concat('"', n_name, '" -> "', n_regionkey, '";') AS line FROM nation""",
}
