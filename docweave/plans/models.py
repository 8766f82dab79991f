"""Model calls over rows: batches, retries, other providers, a pace.

A provider is made once for each partition and takes a list of texts. Which
provider answered, after how many calls, and what none could answer stand beside
the value; a row comes out once, whatever fails.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Retry(Exception):
    """The provider is busy: the same call may succeed a little later."""


class Refused(Exception):
    """The provider will not answer this call; another may."""


class Provider(Protocol):
    name: str

    def __call__(self, texts: list[str]) -> list: ...


class Pace:
    """At least ``interval`` seconds between two calls of one key."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self._next: dict[str, float] = {}

    def wait(self, key: str) -> None:
        now = self.clock()
        ready = self._next.get(key, now)
        if ready > now:
            self.sleep(ready - now)
        self._next[key] = max(ready, now) + self.interval


class Client:
    """Providers in order, with retries and a pace."""

    def __init__(self, providers: list[Provider], *, retries: int = 3, backoff: float = 0.5, interval: float = 0.0, sleep: Callable[[float], None] = time.sleep):
        self.providers, self.retries, self.backoff, self.sleep = providers, retries, backoff, sleep
        self.pace = Pace(interval, sleep=sleep)

    def _one(self, provider: Provider, texts: list[str]) -> tuple[list | None, int, str]:
        """(values or None, calls, last error) of one provider."""
        error = ""
        for k in range(self.retries + 1):
            self.pace.wait(provider.name)
            try:
                values = list(provider(texts))
                if len(values) != len(texts):
                    raise Refused(f"{len(values)} answers to {len(texts)} texts")
                return values, k + 1, ""
            except Retry as e:
                error = f"{provider.name}: {e}"
                if k < self.retries:
                    self.sleep(self.backoff * 2**k)
            except Exception as e:  # noqa: BLE001  a broken provider is as one that refuses
                return None, k + 1, f"{provider.name}: {e}"
        return None, self.retries + 1, error

    def ask(self, texts: list[str], first: int = 0, calls: int = 0, error: str = "") -> list[tuple]:
        """(value, provider, calls, error) for each text. A batch that a provider
        refuses is halved, so one text that it can't take doesn't cost it the
        others; single ones go to the next provider."""
        if first == len(self.providers):
            return [(None, None, calls, error)] * len(texts)
        provider = self.providers[first]
        values, n, said = self._one(provider, texts)
        if values is not None:
            return [(v, provider.name, calls + n, None) for v in values]
        if len(texts) == 1:
            return self.ask(texts, first + 1, calls + n, said)
        half = len(texts) // 2
        return self.ask(texts[:half], first, calls + n, said) + self.ask(texts[half:], first, calls + n, said)


def call_models(rows: DataFrame, id_col: str, text_col: str, make: Callable[[], list[Provider]], *, value_type: str = "string", batch: int = 32, partitions: int | None = None, rate: float | None = None, retries: int = 3, backoff: float = 0.5) -> DataFrame:
    """id, value, provider, calls, error: one row for every row.

    ``make`` builds a partition's providers. ``rate`` is the calls a second of each
    provider over all partitions; it needs ``partitions``, among which it is shared.
    Null texts are empty ones.
    """
    if rate and not partitions:
        raise ValueError("a rate is shared among a given number of partitions")
    interval = partitions / rate if rate else 0.0
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, value {value_type}, provider string, calls int, error string"
    value_kind = rows.sparkSession.createDataFrame([], schema).schema["value"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(value_kind)
        client = Client(make(), retries=retries, backoff=backoff, interval=interval)
        for b in batches:
            texts = b.column(1).to_pylist()
            found: list[tuple] = []
            for s in range(0, len(texts), batch):
                found += client.ask(texts[s : s + batch])
            value, provider, calls, error = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value, arrow), pa.array(provider, pa.string()), pa.array(calls, pa.int32()), pa.array(error, pa.string())], ["id", "value", "provider", "calls", "error"])

    shaped = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (shaped.repartition(partitions) if partitions else shaped).mapInArrow(run, schema)
