"""Rolling guards and ingestion as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Events by fixed windows; ones later than ``late`` are dropped in a stream."""
    src = events.withWatermark(ts, late) if late else events
    g = src.groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, size: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    src = events.withWatermark(ts, late) if late else events
    g = src.groupBy(F.window(ts, size, step), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Runs of events with no longer pause than ``gap``."""
    src = events.withWatermark(ts, late) if late else events
    g = src.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), *keys, "n")


def dedup(files: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first file of each content; what comes again within ``late`` goes."""
    return files.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def rolling_risk(events: DataFrame, minutes: int = 30, limit: int = 150) -> DataFrame:
    """session, event_id, rolling, blocked: sums of the last minutes of each
    session, kept as state in a stream and dropped after that time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    span = minutes * 60_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        us, risk = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        rows = pd.concat(batches).sort_values(["us", "event_id"])
        for r in rows.itertuples():
            us.append(int(r.us))
            risk.append(int(r.risk))
            keep = next(i for i, t in enumerate(us) if r.us - t <= span)
            us, risk = us[keep:], risk[keep:]
            out.append((key[0], int(r.event_id), sum(risk), sum(risk) >= limit))
        state.update((us, risk))
        state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame(out, columns=["session", "event_id", "rolling", "blocked"])

    timed = events.select("session", "event_id", F.unix_micros("ts").alias("us"), F.col("risk").cast("long").alias("risk"))
    return timed.groupBy("session").applyInPandasWithState(
        run, "session long, event_id long, rolling long, blocked boolean", "us array<long>, risk array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def write_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):  # noqa: ANN201
    """Each micro-batch to ``sink(batch, id)``; without ``every`` what is there
    is read once and the query ends."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def two_sinks(all_path: str, security_path: str, kinds: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """All events to one folder, the security ones also to another. Each batch has
    a part of its own that a repeated attempt replaces, so none is written twice."""

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{all_path}/batch={n}")
        batch.where(F.col("event_type").isin(*kinds)).write.mode("overwrite").parquet(f"{security_path}/batch={n}")

    return sink
