"""Queries over events and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions.text import strip_fence
from chartloom.operators import events as E
from chartloom.sources.tables import read


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def job_latest_state(spark, sf_dir):
    return E.latest_state(_events(spark, sf_dir), "user_id")


def job_ttl(spark, sf_dir):
    return E.unexpired(_events(spark, sf_dir), "user_id", 86400)


def rate_limit_window(spark, sf_dir):
    return E.rate_window(_events(spark, sf_dir), "event_type", 3600)


def running_mean(spark, sf_dir):
    return E.running_mean(_events(spark, sf_dir), "user_id")


def provider_fallback(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 3).alias("request_id"), F.pmod("event_id", F.lit(3)).alias("chain_pos"), F.col("event_type").alias("provider"), (F.col("user_id") % 4 != 0).alias("healthy"), (F.col("event_type") != "error").alias("success"), (F.col("value") / 100).alias("confidence")
    )
    return E.fallback(e)


def ext_tumbling(spark, sf_dir):
    return E.tumbling(_events(spark, sf_dir), "1 hour")


def ext_sliding(spark, sf_dir):
    return E.sliding(_events(spark, sf_dir), "2 hours", "1 hour")


def ext_session(spark, sf_dir):
    return E.sessions(_events(spark, sf_dir), "user_id", "30 minutes")


def json_props(spark, sf_dir):
    """The number in each event's JSON, fences and trailing commas aside, by type."""
    e = read(spark, sf_dir, "events").select("event_type", F.from_json(strip_fence(F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))), "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"))


def dates_and_ids(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("run_id"), F.left(F.md5(F.col("o_orderkey").cast("string")), F.lit(8)).alias("short_hash"), F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1)).cast("string").alias("month_start"))


def manifest_diff(spark, sf_dir):
    """Orders added and gone between two years, by customer segment."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    by = o.groupBy("c_mktsegment").agg(F.count_if(F.year("o_orderdate") == 1996).alias("a"), F.count_if(F.year("o_orderdate") == 1997).alias("b"))
    return by.select("c_mktsegment", F.greatest(F.lit(0), F.col("b") - F.col("a")).alias("added"), F.greatest(F.lit(0), F.col("a") - F.col("b")).alias("removed"))


def audit_coverage(spark, sf_dir):
    """Suppliers by nation and region, with the nations that have none."""
    n = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.round(F.avg("s_acctbal"), 6).alias("balance"))
    return n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("r_name", "n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "balance")


def set_operations(spark, sf_dir):
    """Sizes of union, intersection and differences of the parts of two years."""
    part = lambda y: read(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == y).select("l_partkey").distinct()
    a, b = part(1995).withColumn("a", F.lit(1)), part(1996).withColumn("b", F.lit(1))
    j = a.join(b, "l_partkey", "full")
    return j.agg(F.count("*").alias("both_or_either"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))


QUERIES = {f.__name__: f for f in (job_latest_state, job_ttl, rate_limit_window, running_mean, provider_fallback, ext_tumbling, ext_sliding, ext_session, json_props, dates_and_ids, manifest_diff, audit_coverage, set_operations)}

_STATE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'unknown' END"
ORACLES = {
    "job_latest_state": f"SELECT user_id, {_STATE} AS state, event_id AS last_event, events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS events FROM events) WHERE r = 1",
    "job_ttl": 'SELECT user_id, max(ts) AS "last" FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND',
    "rate_limit_window": "SELECT event_id, event_type, count(*) OVER w AS requests, round(sum(value) OVER w, 6) AS total FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)",
    "running_mean": "SELECT event_id, user_id, row_number() OVER w AS n, round(avg(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "provider_fallback": """WITH a AS (SELECT event_id // 3 AS request_id, event_id % 3 AS p, event_type AS provider, user_id % 4 <> 0 AND event_type <> 'error' AND (value / 100 >= 0.7 OR event_id % 3 = max(event_id % 3) OVER (PARTITION BY event_id // 3)) AS ok FROM events)
      SELECT request_id, arg_min(provider, p) FILTER (ok) AS provider, count(*) AS attempts, CASE WHEN count(*) FILTER (ok) > 0 THEN 'answered' ELSE 'exhausted' END AS outcome FROM a GROUP BY 1""",
    "ext_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "ext_sliding": "SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2",
    "ext_session": """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
      SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "json_props": "SELECT event_type, count(CAST(props->>'$.k' AS BIGINT)) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1",
    "dates_and_ids": "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS run_id, left(md5(CAST(o_orderkey AS VARCHAR)), 8) AS short_hash, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start FROM orders",
    "manifest_diff": "SELECT c_mktsegment, greatest(0, b - a) AS added, greatest(0, a - b) AS removed FROM (SELECT c_mktsegment, count(*) FILTER (year(o_orderdate) = 1996) AS a, count(*) FILTER (year(o_orderdate) = 1997) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)",
    "audit_coverage": "SELECT r_name, n_name, coalesce(suppliers, 0) AS suppliers, balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers, round(avg(s_acctbal), 6) AS balance FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey",
    "set_operations": "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE year(l_shipdate) = 1995), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE year(l_shipdate) = 1996) SELECT count(*) AS both_or_either, count(a.k) FILTER (b.k IS NOT NULL) AS common, count(*) FILTER (b.k IS NULL) AS only_first, count(*) FILTER (a.k IS NULL) AS only_second FROM a FULL JOIN b ON a.k = b.k",
}
