"""Queries on time series and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import text, timeseries
from quarry.plans.common import rounded, table


def _daily(spark, d):
    """Event totals by type and day."""
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("v"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def q(f, source=_daily, digits=6):
    return lambda spark, d: rounded(f(source(spark, d)), digits)


K = ("event_type", "day", "v")
QUERIES = {
    "lagged_matrix": q(lambda x: timeseries.lagged_matrix(x, *K, lags=3, horizon=2).select("event_type", "day", F.col("x")[0].alias("x0"), F.col("x")[2].alias("x2"), "y")),
    "difference": q(lambda x: timeseries.difference(x, *K, periods=1, times=2), digits=4),
    "rolling_mean": q(lambda x: timeseries.rolling_mean(x, *K, window=3)),
    "autocorrelation": q(lambda x: timeseries.autocorrelation(x, *K, max_lag=3)),
    "partial_autocorrelation": q(lambda x: timeseries.partial_autocorrelation(x, *K, max_lag=2)),
    "exponential_smoothing": q(lambda x: timeseries.exponential_smoothing(x, *K, alpha=0.3)),
    "cusum_change_points": q(lambda x: timeseries.cusum(x, *K, threshold=300.0, drift=5.0)),
    "resample": q(lambda x: timeseries.resample(x, "event_type", "ts", "value", "6 hours"), lambda s, d: table(s, d, "events"), 9),
    "ar1": q(lambda x: timeseries.ar1(x, *K), digits=6),
    "align_channels": q(lambda x: timeseries.aligned(x.select("event_type", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6).alias("t"), "value"), "event_type", "t", "value", 1 / 3600.0, 5400.0).groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("have"), F.avg("value").alias("mean")), lambda s, d: table(s, d, "events"), 4),
    "tokens": q(lambda x: x.select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"), F.size(text.sentences(F.col("text"))).alias("sentences"), F.length(text.normalized(F.col("text"))).alias("chars")), _docs),
    "bigram_counts": q(lambda x: text.term_counts(x, "text", 2, 2), _docs),
    "vocabulary": q(lambda x: text.vocabulary(x, "text", min_freq=50), _docs),
    "tfidf": q(lambda x: text.tfidf(x, "doc_id", "text"), _docs),
    "ngram_lm_counts": q(lambda x: text.language_model(x, "text", 2, 1.0), lambda s, d: table(s, d, "conversations")),
    "cooccurrence": q(lambda x: text.cooccurrence(x, "doc_id", "text", 2), _docs),
    "encode_padded": q(lambda x: text.encoded(x, "doc_id", "text", text.vocabulary(x, "text")).select("doc_id", F.array_join("ids", " ").alias("ids")), _docs),
    "hashed_terms": q(lambda x: text.hashed_terms(x, "doc_id", "text", 1 << 12).groupBy("doc_id").agg(F.sum("tf").alias("n")), _docs),
}

_D = "s AS (SELECT event_type, date_trunc('day', ts) AS day, round(sum(value), 2) AS v FROM events GROUP BY 1, 2)"
_W = "PARTITION BY event_type ORDER BY day"
_T = "w AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9'']+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS term FROM w)"
_ACF = f"{_D}, c AS (SELECT event_type, day, v - avg(v) OVER (PARTITION BY event_type) AS d FROM s), a AS (SELECT event_type, sum(d * l1) / sum(d * d) AS r1, sum(d * l2) / sum(d * d) AS r2, sum(d * l3) / sum(d * d) AS r3 FROM (SELECT *, lag(d, 1) OVER ({_W}) AS l1, lag(d, 2) OVER ({_W}) AS l2, lag(d, 3) OVER ({_W}) AS l3 FROM c) GROUP BY 1)"
_V = "v AS (SELECT term, count(*) AS n FROM u GROUP BY 1 HAVING count(*) >= 50)"
ORACLES = {
    "lagged_matrix": f"WITH {_D} SELECT event_type, day, round(v, 6) AS x0, round(lead(v, 2) OVER ({_W}), 6) AS x2, round(lead(v, 4) OVER ({_W}), 6) AS y FROM s QUALIFY lead(v, 4) OVER ({_W}) IS NOT NULL",
    "difference": f"WITH {_D} SELECT event_type, day, round((v - lag(v, 1) OVER ({_W})) - (lag(v, 1) OVER ({_W}) - lag(v, 2) OVER ({_W})), 4) AS diff FROM s QUALIFY row_number() OVER ({_W}) > 2",
    "rolling_mean": f"WITH {_D} SELECT event_type, day, round(avg(v) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean FROM s QUALIFY row_number() OVER ({_W}) >= 3",
    "autocorrelation": f"WITH {_ACF} SELECT event_type, CAST(k AS INTEGER) AS lag, round(CASE k WHEN 0 THEN 1.0 WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END, 6) AS acf FROM a, range(4) t(k)",
    "partial_autocorrelation": f"WITH {_ACF} SELECT event_type, CAST(k AS INTEGER) AS lag, round(CASE k WHEN 0 THEN 1.0 WHEN 1 THEN r1 ELSE (r2 - r1 * r1) / (1 - r1 * r1) END, 6) AS pacf FROM a, range(3) t(k)",
    "exponential_smoothing": f"""WITH RECURSIVE {_D}, o AS (SELECT *, row_number() OVER ({_W}) AS k FROM s), r AS (SELECT event_type, day, k, v AS m FROM o WHERE k = 1 UNION ALL SELECT o.event_type, o.day, o.k, 0.3 * o.v + 0.7 * r.m FROM r JOIN o ON o.event_type = r.event_type AND o.k = r.k + 1)
 SELECT event_type, day, round(m, 6) AS smooth FROM r""",
    "cusum_change_points": f"""WITH RECURSIVE {_D}, o AS (SELECT *, row_number() OVER ({_W}) AS k, v - avg(v) OVER (PARTITION BY event_type) AS d FROM s),
 r AS (SELECT event_type, day, k, greatest(0.0, d - 5) AS a, greatest(0.0, -d - 5) AS b FROM o WHERE k = 1 UNION ALL SELECT o.event_type, o.day, o.k, greatest(0.0, CASE WHEN r.a > 300 OR r.b > 300 THEN 0 ELSE r.a END + o.d - 5), greatest(0.0, CASE WHEN r.a > 300 OR r.b > 300 THEN 0 ELSE r.b END - o.d - 5) FROM r JOIN o ON o.event_type = r.event_type AND o.k = r.k + 1)
 SELECT event_type, day FROM r WHERE a > 300 OR b > 300""",
    "resample": "SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS ts, count(*) AS n, round(sum(value), 9) AS total, round(avg(value), 9) AS mean FROM events GROUP BY 1, 2",
    "ar1": f"WITH {_D}, p AS (SELECT event_type, v AS x, lead(v) OVER ({_W}) AS y FROM s) SELECT event_type, round(regr_slope(y, x), 6) AS phi, round(regr_intercept(y, x), 6) AS intercept FROM p WHERE y IS NOT NULL GROUP BY 1",
    "tokens": "SELECT doc_id, len(regexp_extract_all(lower(text), '[A-Za-z0-9'']+'))::INTEGER AS n, len(list_filter(string_split_regex(regexp_replace(trim(text, E' \\t\\n\\r'), '([.!?])\\s+', E'\\\\1\\x01', 'g'), '\\x01'), lambda x: x <> ''))::INTEGER AS sentences, length(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))::INTEGER AS chars FROM documents",
    "bigram_counts": "WITH w AS (SELECT regexp_extract_all(lower(text), '[A-Za-z0-9'']+') AS w FROM documents), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w) SELECT term, count(*) AS n FROM b GROUP BY 1",
    "vocabulary": f"WITH {_T}, {_V} SELECT term, n, row_number() OVER (ORDER BY n DESC, term) + 1 AS id FROM v",
    "tfidf": f"""WITH {_T}, t AS (SELECT doc_id, term, count(*) AS tf FROM u GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), x AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM t JOIN f USING (term))
 SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""",
    "ngram_lm_counts": """WITH w AS (SELECT regexp_extract_all(lower(text), '[A-Za-z0-9'']+') AS w FROM conversations), p AS (SELECT list_concat(['<s>'], list_concat(w, ['</s>'])) AS p FROM w), g AS (SELECT unnest(list_transform(range(1, len(p)), lambda i: {'c': p[i], 't': p[i + 1]})) AS g FROM p),
 n AS (SELECT g.c AS context, g.t AS token, count(*) AS n FROM g GROUP BY 1, 2), s AS (SELECT count(DISTINCT x) + 2 AS v FROM (SELECT unnest(w) AS x FROM w)), t AS (SELECT *, sum(n) OVER (PARTITION BY context) AS total FROM n)
 SELECT context, token, n AS count, CAST(total AS BIGINT) AS context_count, round((n + 1.0) / (total + v), 6)::DOUBLE AS prob FROM t, s""",
    "cooccurrence": "WITH w AS (SELECT regexp_extract_all(lower(text), '[A-Za-z0-9'']+') AS w FROM documents), p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: {'l': w[i], 'r': w[i + 1]})) AS p FROM w UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: {'l': w[i], 'r': w[i + 2]})) FROM w) SELECT p.l AS \"left\", p.r AS \"right\", count(*) AS n FROM p GROUP BY 1, 2",
    "hashed_terms": f"WITH {_T} SELECT doc_id, count(*) AS n FROM u GROUP BY 1",
}
