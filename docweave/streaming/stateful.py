"""Rolling guards and log batches as stateful streams (``transformWithState``).

State is a list for each key in RocksDB, so it outlives restarts, spills to disk
and costs a task only the keys it holds. Event-time timers clear what a window no
longer sees and flush what has waited long enough.

Rows of one key in one micro-batch are taken in order of time and item. A row
that comes after younger ones of an earlier batch, but within the watermark, is
judged at the youngest time seen, as by a clock that never runs backwards; rows
behind the watermark are dropped by Spark. Null keys pass unjudged where a guard
is asked (fail open) and are not held.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """Stateful processors need this store; the session's own comes back after."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch (its size is bounded by the source's rate)."""
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class _Window(StatefulProcessor):
    """What of a key's last ``minutes`` is held: (time, amount) as a list."""

    def __init__(self, minutes: int, limit: int, refuse: bool):
        self.span, self.limit, self.refuse = minutes * 60_000_000, limit, refuse

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long, amount long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        held = [(int(u), int(a)) for u, a in self.held.get()] if self.held.exists() else []
        used, first = sum(a for _, a in held), 0
        clock = held[-1][0] if held else None
        items, totals, ok = [], [], []
        batch = _in_order(rows, ["us", "item"])
        for us, item, amount in zip(batch["us"].tolist(), batch["item"].tolist(), batch["amount"].tolist()):
            clock = us if clock is None else max(clock, us)
            while first < len(held) and clock - held[first][0] > self.span:
                used -= held[first][1]
                first += 1
            if self.refuse:
                fits = used + amount <= self.limit
            else:
                fits = True
            if fits:  # a refused request uses nothing
                held.append((clock, int(amount)))
                used += amount
            items.append(item)
            totals.append(used)
            ok.append(fits if self.refuse else used >= self.limit)
        held = held[first:]
        if held:
            self.held.put(held)
            self._wake(held[-1][0])
        elif first:
            self.held.clear()
        yield pd.DataFrame({"key": key[0], "item": items, "total": totals, "verdict": ok})

    def _wake(self, us: int) -> None:
        """One timer for a key: when its youngest entry leaves the window."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.handle.registerTimer((us + self.span) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def _window(events: DataFrame, key: str, ts: str, item: str, amount: str, late: str, processor: _Window) -> DataFrame:
    # the column with the watermark goes along: timers and the dropping of late rows need it
    timed = events.withWatermark(ts, late).where(F.col(key).isNotNull())
    shaped = timed.select(F.col(key).cast("long").alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.col(item).cast("long").alias("item"), F.col(amount).cast("long").alias("amount"))
    return shaped.groupBy("key").transformWithStateInPandas(processor, "key long, item long, total long, verdict boolean", "Append", "EventTime")


def session_risk(events: DataFrame, *, key: str, ts: str, item: str, score: str, minutes: int = 30, limit: int = 150, late: str = "1 hour") -> DataFrame:
    """key, item, total (scores of the last minutes, its own included), verdict
    (true: the session is blocked)."""
    return _window(events, key, ts, item, score, late, _Window(minutes, limit, False))


def token_quota(requests: DataFrame, *, key: str, ts: str, item: str, tokens: str, limit: int, minutes: int, late: str = "1 hour") -> DataFrame:
    """key, item, total (tokens held after it), verdict (true: admitted)."""
    return _window(requests, key, ts, item, tokens, late, _Window(minutes, limit, True))


class _Batches(StatefulProcessor):
    """Log rows wait until ``size`` are there or the first has waited ``wait_ms``."""

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait = size, wait_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us long, item long")
        self.number = handle.getValueState("number", "n long")

    def _flush(self, key, waiting: list, out: list) -> None:  # noqa: ANN001
        n = int(self.number.get()[0]) if self.number.exists() else 0
        out += [(*key, n, k, i) for k, (_, i) in enumerate(waiting)]
        self.number.update((n + 1,))
        waiting.clear()

    def _keep(self, waiting: list) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if waiting:
            self.rows.put(waiting)
            self.handle.registerTimer((waiting[0][0] + self.wait) // 1000)
        elif self.rows.exists():
            self.rows.clear()

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["kind", "lane", "batch", "place", "item"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        waiting = [(int(u), int(i)) for u, i in self.rows.get()] if self.rows.exists() else []
        out: list[tuple] = []
        batch = _in_order(rows, ["us", "item"])
        for us, item in zip(batch["us"].tolist(), batch["item"].tolist()):
            if waiting and us - waiting[0][0] >= self.wait:
                self._flush(key, waiting, out)
            waiting.append((us, item))
            if len(waiting) >= self.size:
                self._flush(key, waiting, out)
        self._keep(waiting)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        waiting = [(int(u), int(i)) for u, i in self.rows.get()] if self.rows.exists() else []
        out: list[tuple] = []
        if waiting and (waiting[0][0] + self.wait) // 1000 <= timerValues.getCurrentWatermarkInMs():
            self._flush(key, waiting, out)
        self._keep(waiting)
        yield self._frame(out)

    def close(self) -> None:
        pass


def log_batches(events: DataFrame, *, kind: str, ts: str, item: str, lanes: int = 16, size: int = 50, wait: float = 5.0, late: str = "0 seconds") -> DataFrame:
    """kind, lane, batch, place, item: log rows as they are flushed together.

    Rows of a kind are dealt to lanes by their item, so that no kind is one task;
    a batch has up to ``size`` rows of a lane and waits ``wait`` seconds at most.
    A file sink with a checkpoint writes each batch once, also after a restart.
    """
    timed = events.withWatermark(ts, late)
    lane = F.pmod(F.col(item).cast("long"), F.lit(lanes)).cast("int")
    shaped = timed.select(F.coalesce(F.col(kind), F.lit("")).alias("kind"), lane.alias("lane"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.col(item).cast("long").alias("item"))
    return shaped.groupBy("kind", "lane").transformWithStateInPandas(_Batches(size, int(wait * 1000)), "kind string, lane int, batch long, place long, item long", "Append", "EventTime")


def run_to_files(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Everything that is there now into files, each row once; a later call with
    the same folders goes on where this one ended."""
    with rocks_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
