"""Stream operators, run over the shared tables as batches (the same plans run
as streams; the tests run them so)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming import guards as S


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(time_bucket(INTERVAL 5 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_guard_rate(spark, d):
    w = S.tumbling(_events(spark, d), "ts", "5 minutes", ["event_type"])
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT strftime(s - INTERVAL (k * 5) MINUTE, '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS s, user_id FROM events), range(0, 3) t(k) GROUP BY ALL")
def st_sliding(spark, d):
    w = S.sliding(_events(spark, d), "ts", "15 minutes", "5 minutes", ["user_id"])
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def st_sessions(spark, d):
    w = S.sessions(_events(spark, d), "ts", "6 hours", ["user_id"])
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


@query("SELECT md5(text) AS content, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def st_dedup(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("content")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def st_cancel(spark, d):
    gone = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").join(gone, "user_id", "left_anti").select("user_id", "event_id")
