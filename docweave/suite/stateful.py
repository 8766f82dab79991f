"""Stateful streams over the shared tables: rows land in parts, and the stream is
started anew for each, so state and offsets come from the checkpoint."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources.shared import shared_folder, spread, write_file
from ..sources.watch import watch_folder
from ..streaming import guards
from ..streaming import stateful as T
from .guards import quota_sql


def _streamed(spark, events, make, parts=3, end=None):
    """Rows of ``make(stream)``: events land in ``parts`` by time, ``end`` (a row
    behind all others) last."""
    landed, out, checkpoint = (shared_folder(spark, k) for k in ("landed", "out", "checkpoint"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    part = F.least(F.floor((F.col("ts").cast("double") - F.lit(first).cast("double")) / (F.lit(last).cast("double") - F.lit(first).cast("double")) * parts), F.lit(parts - 1))
    stream = make(spark.readStream.schema(events.schema).parquet(f"{landed}/*"))
    for k in range(parts):
        events.where(part == k).write.parquet(f"{landed}/part={k}")
        T.run_to_files(stream, out, checkpoint)
    if end is not None:
        end.select(events.columns).write.parquet(f"{landed}/end")
        T.run_to_files(stream, out, checkpoint)
    return spark.read.parquet(out)


def _events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.floor("value").cast("long").alias("amount"))


@query("SELECT user_id, event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER w AS BIGINT) AS risk, sum(CAST(floor(value) AS BIGINT)) OVER w >= 150 AS blocked FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTES PRECEDING AND CURRENT ROW)")
def st_session_risk(spark, d):
    out = _streamed(spark, _events(spark, d), lambda s: T.session_risk(s, key="user_id", ts="ts", item="event_id", score="amount"))
    return out.select(F.col("key").alias("user_id"), F.col("item").alias("event_id"), F.col("total").alias("risk"), F.col("verdict").alias("blocked"))


@query(quota_sql(300, 60 * 24))
def st_quota(spark, d):
    out = _streamed(spark, _events(spark, d), lambda s: T.token_quota(s, key="user_id", ts="ts", item="event_id", tokens="amount", limit=300, minutes=60 * 24))
    return out.select(F.col("key").alias("user_id"), F.col("item").alias("event_id"), F.col("verdict").alias("admitted"))


_WAIT = 6 * 3600


@query(
    f"""WITH RECURSIVE e AS (SELECT event_type AS kind, CAST(event_id % 4 AS INTEGER) AS lane, event_id AS item, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type, event_id % 4 ORDER BY ts, event_id) AS r FROM events),
    f(kind, lane, r, item, batch, place, begun, n, next) AS (SELECT DISTINCT kind, lane, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM e
      UNION ALL SELECT kind, lane, r, item, b, p, CASE WHEN p = 0 THEN us ELSE begun END, CASE WHEN p = 49 THEN 0 ELSE p + 1 END, CASE WHEN p = 49 THEN b + 1 ELSE b END FROM (
        SELECT f.kind, f.lane, e.r, e.item, e.us, f.begun, CASE WHEN n = 0 OR e.us - begun >= {_WAIT * 1_000_000} THEN 0 ELSE n END AS p,
          next + CASE WHEN n > 0 AND e.us - begun >= {_WAIT * 1_000_000} THEN 1 ELSE 0 END AS b FROM f JOIN e ON e.kind = f.kind AND e.lane = f.lane AND e.r = f.r + 1))
    SELECT kind, lane, batch, place, item FROM f WHERE r > 0"""
)
def st_log_batch(spark, d):
    events = _events(spark, d)
    end = events.agg(F.max("event_id").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"), F.max("user_id").alias("user_id"), F.lit("end of stream").alias("event_type"), F.lit(0).cast("long").alias("amount"))
    return _streamed(spark, events, lambda s: T.log_batches(s, kind="event_type", ts="ts", item="event_id", lanes=4, wait=_WAIT), end=end)


#: files of a micro-batch: all, as a run that ends by itself takes one batch only
FILES = 1 << 40


def _land(pages, folder, prefix=""):
    """A file for each page; a page without text says so in its name."""

    def write(batches):
        for b in batches:
            for i, html in zip(*(c.to_pylist() for c in b.columns)):
                write_file(folder, f"{prefix}{i}.{'none' if html is None else 'html'}", (html or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    spread(pages.select("page_id", "html")).mapInArrow(write, "n long").agg(F.sum("n")).first()


def _told():
    """Size and digest of files' contents, null for pages without text."""
    some = ~F.endswith("name", F.lit(".none"))
    return F.when(some, F.col("size")).alias("size"), F.when(some, F.sha2("content", 256)).alias("digest")


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS digest, page_id % 2 AS wave FROM pages", name="src_dir_watch")
def src_dir_watch(spark, d):
    """Pages land as files in two waves; the stream runs, stops and goes on."""
    folder, done, out, checkpoint = (shared_folder(spark, k) for k in ("inbox", "done", "out", "checkpoint"))
    for wave in (0, 1):
        _land(table(spark, d, "pages").where(F.col("page_id") % 2 == wave), folder)
        files = watch_folder(spark, folder, done, stable_seconds=0.2, max_files=FILES)
        told = files.select(F.regexp_extract("name", "^([0-9]+)", 1).cast("long").alias("page_id"), *_told(), F.lit(wave).cast("long").alias("wave"))
        T.run_to_files(told, out, checkpoint)
    return spark.read.parquet(out)


@query("SELECT 'all' AS place, event_id FROM events UNION ALL SELECT 'security', event_id FROM events WHERE event_type IN ('error', 'purchase')", name="snk_logs")
def snk_logs(spark, d):
    """All events to one sink, the security ones to another too, over a restart."""
    landed, every, security, checkpoint = (shared_folder(spark, k) for k in ("landed", "all", "security", "checkpoint"))
    events = _events(spark, d)
    stream = spark.readStream.schema(events.schema).parquet(f"{landed}/*")
    for k in (0, 1):
        events.where(F.col("event_id") % 2 == k).write.parquet(f"{landed}/part={k}")
        guards.write_batches(stream, guards.two_sinks(every, security, ("error", "purchase")), checkpoint).awaitTermination()
    told = lambda path, place: spark.read.parquet(path).select(F.lit(place).alias("place"), "event_id")
    return told(every, "all").unionByName(told(security, "security"))


@query("SELECT sha256(html) AS digest, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages GROUP BY ALL", name="st_watch")
def st_watch(spark, d):
    """Every page lands twice, in two waves under other names; contents count once."""
    folder, done, out, checkpoint = (shared_folder(spark, k) for k in ("inbox", "done", "out", "checkpoint"))
    told = watch_folder(spark, folder, done, stable_seconds=0.2, max_files=FILES).select(*_told()).dropDuplicates(["digest"])
    for wave in (0, 1):
        _land(table(spark, d, "pages"), folder, f"{wave}-")
        T.run_to_files(told, out, checkpoint)
    return spark.read.parquet(out)
