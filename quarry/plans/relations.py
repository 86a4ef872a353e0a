"""Queries on relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.plans.common import rounded, table


def t(name):
    return lambda spark, d: table(spark, d, name)


def q(f, *names, digits=6):
    return lambda spark, d: rounded(f(*(table(spark, d, n) for n in names)), digits)


def _lookup(c, n):
    return R.lookup(c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_nationkey")).cast("long").alias("n_nationkey")), n.withColumn("n_nationkey", F.col("n_nationkey").cast("long")), "n_nationkey", "n_name", "unknown")


def _bands(p):
    spark = p.sparkSession
    bands = spark.createDataFrame([("low", 0.0, 1200.0), ("mid", 1000.0, 1600.0), ("high", 1600.0, 1e9)], "band string, low double, high double")
    return R.in_range(p.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high").select("p_partkey", "band")


def _merged(li):
    parts = R.partials(li.filter("l_shipdate < '1996-01-01'"), ["l_returnflag"], "l_quantity").unionByName(R.partials(li.filter("NOT l_shipdate < '1996-01-01'"), ["l_returnflag"], "l_quantity"))
    return R.merged(parts, ["l_returnflag"])


def _late(e):
    return R.late(e.select("event_id", "event_type", (F.col("ts").cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 10 * 3600).cast("decimal(18,6)"))).alias("ts")), "event_type", "event_id", "ts", 10000.0).groupBy("event_type").agg(F.count_if("late").alias("late"), F.count("*").alias("n"))


def _zip(c, s):
    return R.zipped(c.select("c_custkey"), s.select("s_suppkey"), ["c_custkey"], ["s_suppkey"])


def _inserted(o):
    known = o.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    return R.inserted(known, o.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


def _sessions(e):
    x = R.sessions(e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "6 hours")
    return x.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


def _sliding(e):
    x = R.sliding(e.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", "value", "2 days", "1 day")
    return x.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


def _grid(li):
    cells = li.groupBy((F.col("l_suppkey") % 5).cast("long").alias("r"), F.col("l_linenumber").cast("long").alias("c")).agg(F.count("*").alias("v"))
    return R.prefix_sums(cells, "r", "c", "v").select("r", "c", F.col("integral").cast("long").alias("integral"))


QUERIES = {
    "rel_subset": q(lambda n: R.subset(n, [2, "n_name"], "passthrough"), "nation"), "rel_mask": q(lambda n: R.by_mask(n.select("n_nationkey", "n_name", "n_regionkey"), [True, False, True]), "nation"), "rel_above": q(lambda p: R.above(p, "p_retailprice", 1500.0).select("p_partkey"), "part"),
    "rel_lookup": q(_lookup, "customer", "nation"), "rel_semi": q(lambda c, o: R.semi(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]), "customer", "orders"),
    "rel_anti": q(lambda c, o: R.anti(c.select("c_custkey"), o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]), "customer", "orders"), "rel_range_join": q(_bands, "part"), "rel_zip": q(_zip, "customer", "supplier"),
    "rel_first_mode": q(lambda o: R.first_seen_mode(o.select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], "o_orderpriority", "o_orderkey"), "orders"), "rel_partials": q(_merged, "lineitem"),
    "rel_cube": q(lambda x: R.cubed(x, ["l_returnflag", "l_linestatus"], "l_quantity"), "lineitem", digits=2), "rel_rollup": q(lambda x: R.cubed(x, ["l_returnflag", "l_linestatus"], "l_quantity", True), "lineitem", digits=2),
    "rel_ecdf": q(lambda x: R.ecdf(x, "l_discount"), "lineitem"), "rel_prefix_sums": q(_grid, "lineitem"),
    "rel_ranks": q(lambda c: R.ranked(c.select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")]), "customer"),
    "rel_first_last": q(lambda o: R.first_last(o, ["o_custkey"], "o_orderkey", "o_totalprice"), "orders", digits=2), "rel_leaderboard": q(lambda s: R.leaderboard(s, "s_name", "s_acctbal", 10), "supplier", digits=2),
    "rel_except": q(lambda c, s: R.only_first(c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k")).filter("k < 10")), "customer", "supplier"), "rel_intersect": q(lambda c, s: R.in_both(c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))), "customer", "supplier"),
    "rel_union": q(lambda c, s: R.in_either(c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))), "customer", "supplier"), "rel_insert": q(_inserted, "orders"),
    "rel_sessions": q(_sessions, "events"), "rel_sliding": q(_sliding, "events"), "rel_last_rows": q(lambda e: R.last_rows(e.select("user_id", "event_id", "value"), "user_id", "event_id", 3), "events"), "rel_late": q(_late, "events"),
    "rel_baseline": q(lambda e: R.baseline(e, "event_type", "event_id", "value", 0.2, 1.5).groupBy("event_type", "state").agg(F.count("*").alias("n"), F.round(F.sum("mean"), 3).alias("means")), "events"),
    "rel_bootstrap": q(lambda x: R.bootstrap_means(x.withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "k", "l_quantity", 20), "lineitem"), "rel_sketch": q(lambda x: R.sketch(x, "l_extendedprice"), "lineitem"), "rel_sample": q(lambda x: R.sampled(x.select("o_orderkey"), "o_orderkey", 100), "orders"),
}
_mode = "SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2"
ORACLES = {
    "rel_subset": "SELECT * FROM nation", "rel_mask": "SELECT n_nationkey, n_regionkey FROM nation", "rel_above": "SELECT p_partkey FROM part WHERE p_retailprice > 1500",
    "rel_lookup": "SELECT c_custkey, k AS n_nationkey, coalesce(n_name, 'unknown') AS n_name FROM (SELECT c_custkey, CAST(CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END AS BIGINT) AS k FROM customer) LEFT JOIN nation ON k = n_nationkey",
    "rel_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "rel_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "rel_range_join": "SELECT p_partkey, band FROM part JOIN (VALUES ('low', 0.0, 1200.0), ('mid', 1000.0, 1600.0), ('high', 1600.0, 1e9)) b(band, low, high) ON p_retailprice >= low AND p_retailprice < high",
    "rel_zip": "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) USING (r)",
    "rel_first_mode": f"SELECT o_custkey, o_orderpriority AS mode FROM ({_mode}) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) = 1",
    "rel_partials": "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS variance, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high FROM lineitem GROUP BY 1",
    "rel_cube": "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rel_rollup": "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rel_ecdf": "SELECT l_discount AS value, count(*) AS n, round(sum(count(*)) OVER (ORDER BY l_discount) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM lineitem GROUP BY 1",
    "rel_prefix_sums": "WITH c AS (SELECT CAST(l_suppkey % 5 AS BIGINT) AS r, CAST(l_linenumber AS BIGINT) AS c, count(*) AS v FROM lineitem GROUP BY 1, 2) SELECT a.r, a.c, CAST(sum(b.v) AS BIGINT) AS integral FROM c a JOIN c b ON b.r <= a.r AND b.c <= a.c GROUP BY 1, 2",
    "rel_ranks": "SELECT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal, CAST(rank() OVER w AS INTEGER) AS rank, CAST(dense_rank() OVER w AS INTEGER) AS dense_rank, CAST(ntile(4) OVER w AS INTEGER) AS tile, CAST(row_number() OVER w AS INTEGER) AS row FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)",
    "rel_first_last": "SELECT o_custkey, round(arg_min(o_totalprice, o_orderkey), 2) AS \"first\", round(arg_max(o_totalprice, o_orderkey), 2) AS \"last\" FROM orders GROUP BY 1",
    "rel_leaderboard": "SELECT CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_name) AS INTEGER) AS place, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 10",
    "rel_except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10", "rel_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "rel_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "rel_insert": "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "rel_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM n GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest, CAST(sum(n) AS BIGINT) AS events FROM c GROUP BY 1",
    "rel_sliding": "WITH w AS (SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) SELECT event_type, strftime(s, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2",
    "rel_last_rows": "SELECT user_id, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3",
    "rel_late": "WITH e AS (SELECT event_id, event_type, ts - INTERVAL 1 HOUR * (event_id % 10) AS ts FROM events), m AS (SELECT *, max(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e) SELECT event_type, count(*) FILTER (WHERE epoch(seen) - epoch(ts) > 10000) AS late, count(*) AS n FROM m GROUP BY 1",
    "rel_baseline": """WITH RECURSIVE o AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), r AS (SELECT event_type, k, v, CAST(NULL AS DOUBLE) AS mean, 'warming' AS state, v AS m, CAST(0 AS DOUBLE) AS q FROM o WHERE k = 1
 UNION ALL SELECT o.event_type, o.k, o.v, r.m, CASE WHEN o.k <= 5 THEN 'warming' WHEN abs(o.v - r.m) > 1.5 * sqrt(r.q) THEN 'alert' ELSE 'normal' END, r.m + 0.2 * (o.v - r.m), 0.8 * (r.q + 0.2 * (o.v - r.m) ^ 2) FROM r JOIN o ON o.event_type = r.event_type AND o.k = r.k + 1)
 SELECT event_type, state, count(*) AS n, round(sum(mean), 3) AS means FROM r GROUP BY 1, 2""",
}
