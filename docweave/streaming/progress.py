"""Counts of each step without another pass: metrics that Spark gathers while the
rows go by, in batches and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress:
    """Steps of one batch job. ``step`` marks a place in a plan; once the rows have
    been written, ``report`` has the counts. A plan's steps are counted by the
    action that runs it, once, however many there are."""

    def __init__(self) -> None:
        self._steps: list[tuple[str, Observation]] = []

    def step(self, df: DataFrame, name: str, **more: Column) -> DataFrame:
        seen = Observation(f"{len(self._steps)}-{name}")
        self._steps.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in more.items()))

    def report(self, spark: SparkSession) -> DataFrame:
        """step, place, metric, value: whole numbers; a step without rows has 0."""
        rows = [(name, k, metric, int(value or 0)) for k, (name, seen) in enumerate(self._steps) for metric, value in seen.get.items()]
        return spark.createDataFrame(rows, "step string, place int, metric string, value long")


class StreamProgress(StreamingQueryListener):
    """Sums of a stream's observed metrics over its batches, by step and metric;
    each batch counts once, also if its report comes twice."""

    def __init__(self) -> None:
        self._batches: dict[tuple[str, int], dict[tuple[str, str], int]] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        p = event.progress
        self._batches[str(p.runId), p.batchId] = {(step, m): int(v or 0) for step, row in p.observedMetrics.items() for m, v in row.asDict().items()}

    def onQueryIdle(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802, ANN001
        self.ended[str(event.runId)] = event.exception

    def totals(self) -> dict[tuple[str, str], int]:
        out: dict[tuple[str, str], int] = {}
        for batch in self._batches.values():
            for key, value in batch.items():
                out[key] = out.get(key, 0) + value
        return out
