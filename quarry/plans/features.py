"""Queries on preprocessing, neighbours, models and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import vectors
from quarry.operators import graph, neighbors
from quarry.operators import preprocessing as pre
from quarry.plans.common import rounded, table

C = ["l_quantity", "l_extendedprice"]


def _li(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *C, "l_discount", "l_returnflag")


def _em(spark, d):
    return table(spark, d, "embeddings")


def _trade(spark, d):
    """Customers and the suppliers that served them, an edge a line item."""
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("c_custkey").alias("src"), (F.col("s_suppkey") + 1000000).alias("dst"), F.col("l_quantity").alias("weight"))


def _triples(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("s"), F.lit("in").alias("p"), F.col("n_name").alias("o"))
    return s.unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("s"), F.lit("in").alias("p"), F.col("r_name").alias("o")))


def q(f, source=_li, digits=6):
    return lambda spark, d: rounded(f(source(spark, d)), digits)


def _summed(x):
    """Scaled columns as sums by flag, so that results stay small."""
    return x.groupBy("l_returnflag").agg(*(F.sum(c).alias(f"sum_{c}") for c in C), *(F.max(c).alias(f"max_{c}") for c in C))


def distances(spark, d):
    e = _em(spark, d)
    one = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    a, b = F.col("q"), F.col("embedding")
    named = {k: f(a, b) for k, f in vectors.DISTANCES.items() if k not in ("hamming", "jaccard", "minkowski")} | {"minkowski": vectors.minkowski(a, b, 3.0), "rbf": vectors.rbf_kernel(a, b, 0.5), "laplacian": vectors.laplacian_kernel(a, b, 0.1), "poly": vectors.poly_kernel(a, b, 1.0, 1.0, 2), "sigmoid": vectors.sigmoid_kernel(a, b, 0.5, 0.1)}
    # adding zero turns a negative zero into a plain one
    return e.crossJoin(F.broadcast(one)).select("vec_id", *((F.round(c, 6) + 0.0).alias(k) for k, c in named.items()))


def knn(spark, d):
    e = _em(spark, d)
    return rounded(neighbors.neighbors(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5), 6)


def knn_classify(spark, d):
    e = _em(spark, d)
    return neighbors.knn_classify(neighbors.neighbors(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 7), e, "vec_id", "label")


def nearest_centroid(spark, d):
    e = _em(spark, d)
    return neighbors.nearest_centroid(e, "vec_id", "embedding", neighbors.centroids(e, "label", "embedding"))


def nb(spark, d):
    m = neighbors.gaussian_nb(_li(spark, d), "l_returnflag", C)
    return rounded(m, 4)


def ols(spark, d):
    found = neighbors.ols(_li(spark, d), ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(spark.createDataFrame(list(found.items()), "term string, coefficient double"), 3)


def kmeans(spark, d):
    e = _em(spark, d)
    starts = e.filter("vec_id < 4").select(F.col("vec_id").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))
    return rounded(neighbors.kmeans(e, "vec_id", "embedding", starts, 3).select("label", F.round(vectors.norm(F.col("centroid")), 6).alias("norm")), 6)


def bfs(spark, d):
    return graph.bfs(graph.both_ways(_trade(spark, d).select("src", "dst")), None, 3).groupBy("distance").agg(F.count("*").alias("n"), F.sum("node").alias("nodes"))


def sssp(spark, d):
    return rounded(graph.shortest_paths(graph.both_ways(_trade(spark, d).withColumn("weight", F.col("weight").cast("double")))), 6)


QUERIES = {
    "standard_scale": q(lambda x: _summed(pre.standard_scale(x, C))), "minmax_scale": q(lambda x: _summed(pre.minmax_scale(x, C))), "maxabs_scale": q(lambda x: _summed(pre.maxabs_scale(x, C))), "robust_scale": q(lambda x: _summed(pre.robust_scale(x, C))),
    "impute_median": q(lambda x: _summed(pre.impute(x.withColumn("l_quantity", F.when(F.col("l_quantity") > 10, F.col("l_quantity"))), ["l_quantity"], "median")), digits=2),
    "target_encode": q(lambda x: pre.target_encode(x, "l_returnflag", "l_extendedprice", 5.0)),
    "kbins_quantile": q(lambda x: pre.discretize(x, "l_extendedprice", 4).groupBy("bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"))),
    "ordinal_encode": lambda s, d: pre.ordinal_encode(table(s, d, "part").select("p_partkey", "p_brand"), "p_brand", pre.categories(table(s, d, "part"), "p_brand")),
    "one_hot": lambda s, d: pre.one_hot(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"]).groupBy("o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P").agg(F.count("*").alias("n")),
    "polynomial": q(lambda x: pre.polynomial(x.select(*C), C, 2).agg(*(F.sum(F.col(f"`{c}`")).alias(f"s{k}") for k, c in enumerate(["1", "l_quantity", "l_quantity*l_extendedprice"]))), digits=2),
    "variances": q(lambda x: pre.feature_variances(x, C), digits=4),
    "f_classif": q(lambda x: pre.f_classif(x, C, "l_returnflag")), "f_regression": q(lambda x: pre.f_regression(x, ["l_quantity", "l_discount"], "l_extendedprice"), digits=2),
    "power_exponent": q(lambda x: pre.power_exponent(x, "l_quantity").select("exponent"), digits=4),
    "distances": distances, "knn_neighbors": knn, "knn_classify": knn_classify, "nearest_centroid": nearest_centroid, "gaussian_nb": nb, "ols": ols, "kmeans": kmeans,
    "connected_components": lambda s, d: graph.connected_components(_trade(s, d)).groupBy("component").agg(F.count("*").alias("n")),
    "bfs": bfs, "shortest_paths": sssp, "degrees": lambda s, d: graph.degrees(_trade(s, d)),
    "subgraph_matches": lambda s, d: graph.subgraph_matches(_triples(s, d).select(F.col("s").alias("src"), F.col("o").alias("dst")), [("a", "b"), ("b", "c")]),
    "kg_match": lambda s, d: graph.match(_triples(s, d), [("?s", "in", "?n"), ("?n", "in", "?r")]),
    "kg_infer": lambda s, d: graph.infer(_triples(s, d), [([("?a", "in", "?b"), ("?b", "in", "?c")], ("?a", "in", "?c"))]),
}
_SUM = "SELECT l_returnflag, {0} FROM lineitem, s GROUP BY 1"


def _scaled(stats, expr):
    parts = [f"round({f}({expr.format(c=c)}), 6) AS {f}_{c}" for f in ("sum", "max") for c in C]
    return f"WITH s AS (SELECT {', '.join(stats.format(c=c) for c in C)} FROM lineitem) " + _SUM.format(", ".join(parts))


_E = "e AS (SELECT DISTINCT c_custkey AS src, s_suppkey + 1000000 AS dst, min(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
_P = "p AS (SELECT a.vec_id AS query, b.vec_id AS id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ^ 2))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"
_TR = "t AS (SELECT s_name AS s, n_name AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
_Z = lambda f: f"list_sum(list_transform(list_zip(q, embedding), lambda z: {f}))".replace("A_", "z[1]::DOUBLE").replace("B_", "z[2]::DOUBLE")
ORACLES = {
    "standard_scale": _scaled("avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}", "({c} - m_{c}) / d_{c}"), "minmax_scale": _scaled("min({c}) AS a_{c}, max({c}) AS b_{c}", "({c} - a_{c}) / (b_{c} - a_{c})"),
    "maxabs_scale": _scaled("max(abs({c})) AS b_{c}", "{c} / b_{c}"), "robust_scale": _scaled("median({c}) AS m_{c}, quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}", "({c} - m_{c}) / (b_{c} - a_{c})"),
    "impute_median": "WITH x AS (SELECT l_returnflag, CASE WHEN l_quantity > 10 THEN l_quantity END AS v, l_extendedprice FROM lineitem), m AS (SELECT median(v) AS m FROM x) SELECT l_returnflag, round(sum(coalesce(v, m)), 2) AS sum_l_quantity, round(max(coalesce(v, m)), 2) AS max_l_quantity, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(max(l_extendedprice), 2) AS max_l_extendedprice FROM x, m GROUP BY 1",
    "target_encode": "SELECT l_returnflag AS value, count(*) AS n, round((sum(l_extendedprice) + 5.0 * (SELECT avg(l_extendedprice) FROM lineitem)) / (count(*) + 5.0), 6) AS encoded FROM lineitem GROUP BY 1",
    "kbins_quantile": "WITH e AS (SELECT quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.5) b, quantile_cont(l_extendedprice, 0.75) c FROM lineitem) SELECT CAST((l_extendedprice >= a)::INT + (l_extendedprice >= b)::INT + (l_extendedprice >= c)::INT AS INTEGER) AS bin, count(*) AS n, round(min(l_extendedprice), 6) AS low FROM lineitem, e GROUP BY 1",
    "ordinal_encode": "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand FROM part",
    "one_hot": "SELECT (o_orderstatus = 'F')::DOUBLE AS \"o_orderstatus_F\", (o_orderstatus = 'O')::DOUBLE AS \"o_orderstatus_O\", (o_orderstatus = 'P')::DOUBLE AS \"o_orderstatus_P\", count(*) AS n FROM orders GROUP BY 1, 2, 3",
    "polynomial": "SELECT count(*)::DOUBLE AS s0, round(sum(l_quantity), 2) AS s1, round(sum(l_quantity * l_extendedprice), 2) AS s2 FROM lineitem",
    "variances": " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 4) AS variance FROM lineitem" for c in C),
    "f_classif": " UNION ALL ".join(f"(WITH g AS (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS s FROM lineitem GROUP BY l_returnflag), a AS (SELECT avg({c}) AS m FROM lineitem) SELECT '{c}' AS feature, round((sum(n * (g.m - a.m) ^ 2) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 6) AS f FROM g, a)" for c in C),
    "f_regression": " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice) ^ 2 * (count(*) - 2) / (1 - corr({c}, l_extendedprice) ^ 2), 2) AS f FROM lineitem" for c in ("l_quantity", "l_discount")),
    "distances": f"""WITH x AS (SELECT vec_id, embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q FROM embeddings), y AS (SELECT vec_id, {_Z('(A_ - B_) ^ 2')} AS sq, {_Z('abs(A_ - B_)')} AS l1, {_Z('abs(A_ - B_) ^ 3')} AS l3, {_Z('A_ * B_')} AS ip, sqrt({_Z('A_ ^ 2')}) * sqrt({_Z('B_ ^ 2')}) AS nn,
 {_Z('CASE WHEN abs(A_) + abs(B_) > 0 THEN abs(A_ - B_) / (abs(A_) + abs(B_)) ELSE 0 END')} AS ca, {_Z('abs(A_ + B_)')} AS ab, list_max(list_transform(list_zip(q, embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) AS ch FROM x)
 SELECT vec_id, round(sqrt(sq), 6) AS euclidean, round(sq, 6) AS sqeuclidean, round(l1, 6) AS manhattan, round(ch, 6) AS chebyshev, round(1 - ip / greatest(nn, 1e-12), 6) + 0.0 AS cosine, round(ca, 6) AS canberra, round(CASE WHEN ab > 0 THEN l1 / ab ELSE 0 END, 6) AS bray_curtis, round(l3 ^ (1.0 / 3), 6) AS minkowski,
 round(exp(-0.5 * sq), 6) AS rbf, round(exp(-0.1 * l1), 6) AS laplacian, round((ip + 1) ^ 2, 6) AS poly, round(tanh(0.5 * ip + 0.1), 6) AS sigmoid FROM y""",
    "knn_neighbors": f"WITH {_P} SELECT query, id, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY query ORDER BY d, id) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, id) <= 5",
    "knn_classify": f"WITH {_P}, n AS (SELECT query, id FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, id) <= 7), v AS (SELECT query, label, count(*) AS n FROM n JOIN embeddings ON vec_id = id GROUP BY 1, 2) SELECT query, label AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1",
    "nearest_centroid": "WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2) GROUP BY 1) SELECT vec_id AS id, c.label AS predicted FROM embeddings e, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(e.embedding, c.c), lambda z: (z[1]::DOUBLE - z[2]) ^ 2)), c.label) = 1",
    "gaussian_nb": "SELECT l_returnflag AS label, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS mean_{c}, round(var_pop({c}) + 1e-9, 4) AS var_{c}" for c in C) + " FROM lineitem GROUP BY 1",
    "degrees": f"WITH e AS (SELECT c_custkey AS src, s_suppkey + 1000000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1",
    "bfs": f"WITH RECURSIVE {_E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT min(src) AS node, 0 AS distance FROM b UNION SELECT b.dst, r.distance + 1 FROM r JOIN b ON b.src = r.node WHERE r.distance < 3), m AS (SELECT node, min(distance) AS distance FROM r GROUP BY 1) SELECT distance, count(*) AS n, CAST(sum(node) AS BIGINT) AS nodes FROM m GROUP BY 1",
    "subgraph_matches": f"WITH {_TR} SELECT x.s AS a, x.o AS b, y.o AS c FROM t x JOIN t y ON x.o = y.s WHERE x.s <> y.o",
    "kg_match": f"WITH {_TR} SELECT a.s AS s, a.o AS n, b.o AS r FROM t a JOIN t b ON a.o = b.s",
    "kg_infer": f"WITH {_TR} SELECT s, 'in' AS p, o, false AS derived FROM t UNION ALL SELECT DISTINCT a.s, 'in', b.o, true FROM t a JOIN t b ON a.o = b.s WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.s = a.s AND c.o = b.o)",
    "ols": "WITH m AS (SELECT var_pop(l_quantity) AS vq, var_pop(l_discount) AS vd, covar_pop(l_quantity, l_discount) AS qd, covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS dy, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_extendedprice) AS y FROM lineitem), c AS (SELECT *, (qy * vd - dy * qd) / (vq * vd - qd * qd) AS bq, (dy * vq - qy * qd) / (vq * vd - qd * qd) AS bd FROM m) SELECT 'l_quantity' AS term, round(bq, 3) AS coefficient FROM c UNION ALL SELECT 'l_discount', round(bd, 3) FROM c UNION ALL SELECT 'intercept', round(y - bq * q - bd * d, 3) FROM c",
}
