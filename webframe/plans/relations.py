"""Queries of results, statistics, rates and quotas over the events, and of windows and star joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from webframe.operators import results as R
from webframe.operators import stats as S
from webframe.plans.catalog import query
from webframe.plans.inputs import FETCHES_SQL, FRONTIER_SQL, fetches, frontier
from webframe.session import table

_SAMPLES_SQL = f"WITH {FETCHES_SQL}, s AS (SELECT *, event_id % 3 + 1 AS seconds FROM fetches)"
_LAST20 = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_ERROR_CLASS = "CASE error WHEN 'ConnectionRefused' THEN 'NetworkError' WHEN 'DNSNotFound' THEN 'NetworkError' WHEN 'AuthenticationError' THEN 'ServerError' END"


def _samples(spark, d):
    return fetches(spark, d).withColumn("seconds", F.col("event_id") % 3 + 1)


@query(f"WITH {FETCHES_SQL} SELECT event_id, CASE status_code WHEN 200 THEN 'done' WHEN 302 THEN 'redirect' WHEN 404 THEN 'skipped' ELSE 'error' END AS status FROM fetches")
def status_from_code(spark, d):
    return fetches(spark, d).select("event_id", R.status_of_code(F.col("status_code")).alias("status"))


@query(f"WITH {FETCHES_SQL} SELECT event_id, CASE WHEN error IN ('ConnectionRefused', 'DNSNotFound') THEN 'skipped' ELSE 'error' END AS usual, 'error' AS retried FROM fetches WHERE error IS NOT NULL")
def retry_rules(spark, d):
    e = F.col("error")
    rows = fetches(spark, d).filter(e.isNotNull())
    return rows.select("event_id", R.status_of_error(e).alias("usual"), R.status_of_error(e, True, True).alias("retried"))


@query(f"WITH {FETCHES_SQL} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS size, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration FROM fetches WHERE status_code = 200")
def stats_files_bytes(spark, d):
    return S.totals(fetches(spark, d).filter("status_code = 200"))


@query(f"WITH {FETCHES_SQL} SELECT {_ERROR_CLASS} AS error_class, count(*) AS n FROM fetches WHERE error IS NOT NULL GROUP BY 1")
def stats_errors(spark, d):
    return R.count_errors(fetches(spark, d))


@query(f"WITH {FETCHES_SQL} SELECT CAST(coalesce(min(CASE {_ERROR_CLASS} WHEN 'NetworkError' THEN 4 WHEN 'ServerError' THEN 8 END), 0) AS INTEGER) AS exit_code FROM fetches")
def stats_exit_code(spark, d):
    return R.exit_status(fetches(spark, d))


@query(f"WITH {FETCHES_SQL}, {FRONTIER_SQL} SELECT (SELECT sum(size) FROM fetches) >= 1000000 AND (SELECT count(*) FROM frontier WHERE status = 'todo' AND level = 0) = 0 AS exceeded")
def quota_verdict(spark, d):
    return S.quota_exceeded(fetches(spark, d), frontier(spark, d), 1_000_000)


@query(f"WITH {FETCHES_SQL}, r AS (SELECT event_id, CAST(sum(size) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM fetches) SELECT event_id, running, running >= 20000 AS reached FROM r")
def quota_reached(spark, d):
    return S.quota_reached_at(fetches(spark, d), "user_id", 20_000, "size", F.col("ts"), F.col("event_id")).select("event_id", "running", "reached")


@query(f"{_SAMPLES_SQL} SELECT event_id, CAST(sum(size) {_LAST20} AS DOUBLE) / CAST(sum(seconds) {_LAST20} AS DOUBLE) AS speed FROM s")
def bandwidth_speed(spark, d):
    return S.speed(_samples(spark, d), "user_id", "size", "seconds", F.col("ts"), F.col("event_id")).select("event_id", "speed")


@query(f"{_SAMPLES_SQL}, r AS (SELECT event_id, CAST(sum(size) {_LAST20} AS DOUBLE) / 1024.0::DOUBLE - CAST(sum(seconds) {_LAST20} AS DOUBLE) AS rest FROM s) SELECT event_id, CASE WHEN rest < 0.001 THEN 0.0::DOUBLE ELSE rest END AS sleep FROM r")
def ratelimit_sleep(spark, d):
    return S.sleep_time(_samples(spark, d), "user_id", 1024, "size", "seconds", F.col("ts"), F.col("event_id")).select("event_id", "sleep")


@query(
    f"WITH {FETCHES_SQL}, i AS (SELECT *, sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM fetches) "
    "SELECT event_id, least(10.0::DOUBLE, 0.5::DOUBLE + sum(CASE WHEN error IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS wait FROM i"
)
def backoff_wait(spark, d):
    return S.backoff(fetches(spark, d), "user_id", F.col("error").isNotNull(), 0.5, 10, F.col("ts"), F.col("event_id")).select("event_id", "wait")


@query(
    f"WITH {FETCHES_SQL}, l AS (SELECT *, last_value(CASE WHEN size > 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM fetches), "
    "g AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(seen)) / 1e6 >= 86400, false) AS gap FROM l) "
    "SELECT user_id, count(*) AS n, bool_or(gap) AS stalled FROM g GROUP BY user_id"
)
def stall_sessions(spark, d):
    rows = S.stalls(fetches(spark, d), "user_id", "ts", "size", 86_400)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.bool_or("stalled").alias("stalled"))


def merged_samples(spark, d):
    """Sequential in a user's feeds: tests compare it with a plain loop."""
    return S.merge_samples(fetches(spark, d), "user_id", "ts", "size")


query()(merged_samples)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_window_tumbling(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query(
    "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) "
    "SELECT user_id, min(ts) AS begin, count(*) AS n FROM s GROUP BY user_id, session"
)
def ext_sessionize(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("begin"), "n")


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def ext_star_join_agg(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    rows = items.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment", "o_orderpriority").agg(F.sum("n").alias("n"), F.sum("q").alias("quantity"))
