"""Queries on clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clusters
from quarry.plans.common import rounded, table

C = ["l_quantity", "l_extendedprice"]


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("y"))


QUERIES = {
    "calinski_harabasz": lambda s, d: rounded(clusters.calinski_harabasz(table(s, d, "lineitem"), "l_returnflag", C), 6),
    "davies_bouldin": lambda s, d: rounded(clusters.davies_bouldin(table(s, d, "lineitem"), "l_linenumber", C), 6),
    "within_radius": lambda s, d: rounded(clusters.within_radius(_parts(s, d), "p_partkey", "x", "y", 0.9), 6),
    "dbscan": lambda s, d: clusters.dbscan(_parts(s, d), "p_partkey", "x", "y", 0.9, 4).groupBy("cluster").agg(F.count("*").alias("n")),
}
_P = "p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice / 10 AS y FROM part), e AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS d FROM p a JOIN p b ON a.id <> b.id WHERE sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) <= 0.9)"
ORACLES = {
    "calinski_harabasz": "WITH g AS (SELECT count(*) AS n, avg(l_quantity) AS a, avg(l_extendedprice) AS b, var_pop(l_quantity) AS va, var_pop(l_extendedprice) AS vb FROM lineitem GROUP BY l_returnflag), t AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem) SELECT round(sum(n * ((g.a - t.a) ^ 2 + (g.b - t.b) ^ 2)) * (sum(n) - count(*)) / (sum(n * (va + vb)) * (count(*) - 1)), 6) AS calinski_harabasz FROM g, t",
    "davies_bouldin": "WITH c AS (SELECT l_linenumber AS l, avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem GROUP BY 1), s AS (SELECT l, any_value(a) AS a, any_value(b) AS b, avg(sqrt((l_quantity - a) ^ 2 + (l_extendedprice - b) ^ 2)) AS s FROM lineitem JOIN c ON l = l_linenumber GROUP BY l), r AS (SELECT x.l, max((x.s + y.s) / sqrt((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2)) AS r FROM s x JOIN s y ON x.l <> y.l GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r",
    "within_radius": f"WITH {_P} SELECT a, b, round(d, 6) AS distance FROM e WHERE a < b",
    "dbscan": f"""WITH RECURSIVE {_P}, k AS (SELECT id FROM p WHERE (SELECT count(*) FROM e WHERE a = id) + 1 >= 4), ce AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)),
 r AS (SELECT id AS node, id AS root FROM k UNION SELECT ce.b, r.root FROM r JOIN ce ON ce.a = r.node), m AS (SELECT node, min(root) AS c FROM r GROUP BY 1), o AS (SELECT e.a AS id, min(m.c) AS c FROM e JOIN m ON m.node = e.b GROUP BY 1)
 SELECT coalesce(m.c, o.c) AS cluster, count(*) AS n FROM p LEFT JOIN m ON m.node = p.id LEFT JOIN o ON o.id = p.id GROUP BY 1""",
}
