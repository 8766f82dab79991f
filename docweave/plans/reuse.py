"""Steps whose results are kept by content, so a second run computes only what is new.

A result's key is a digest of the step's name, its version and the input's digest.
Inputs are looked up by key before their content is read: where all keys are there,
no content is. What a step raises becomes a row with the error, and failed keys are
tried again in the next run. Each run appends a part of its own, which Spark commits
as a whole; a run that dies leaves none. Equal contents are computed once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RESULTS = "key string, value string, error string, run string"


@dataclass
class Metrics:
    """What each step of a run did, and for how long."""

    rows: list[dict] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.rows], "step string, run string, inputs long, reused long, computed long, failed long, seconds double")


def python_step(function: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    """A step from a function of one content; its exceptions become errors."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for b in batches:
            values, errors = [], []
            for content in b.column(1).to_pylist():
                value = error = None
                try:
                    value = function(content)
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                values.append(value)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.string()), pa.array(errors, pa.string())], ["key", "value", "error"])

    return lambda df: df.select("key", "content").mapInArrow(run, "key string, value string, error string")


class Store:
    """Results of steps in a folder, by step."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.metrics = Metrics()

    def _path(self, step: str) -> str:
        return f"{self.folder}/step={step}"

    def results(self, step: str) -> DataFrame:
        """The last result of each key; a sound one stands before errors."""
        try:
            found = self.spark.read.schema(_RESULTS).parquet(f"{self._path(step)}/*")
        except AnalysisException:  # nothing is kept yet
            return self.spark.createDataFrame([], _RESULTS)
        last = F.max_by(F.struct("value", "error", "run"), F.struct(F.col("error").isNull().alias("sound"), "run"))
        return found.groupBy("key").agg(last.alias("r")).select("key", "r.*")

    def run(self, step: str, version: str, inputs: DataFrame, function: Callable[[DataFrame], DataFrame], *, digest: str, content: str, label: str) -> DataFrame:
        """``inputs`` with value, error and run of the step. ``function`` takes
        (key, content) and gives (key, value, error)."""
        began = time.monotonic()
        keyed = inputs.withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(step), F.lit(version), F.col(digest)), 256))
        part = f"{self._path(step)}/{label}-{uuid.uuid4().hex}"
        wanted = keyed.select("key").dropDuplicates()
        held = self.results(step).where("error is null").select("key")
        missing = wanted.join(held, "key", "left_anti")
        missing.write.parquet(f"{self.folder}/missing/{part.rpartition('/')[2]}")
        missing = self.spark.read.schema("key string").parquet(f"{self.folder}/missing/{part.rpartition('/')[2]}")
        n = missing.count()
        if n:  # only now is content read, and only of these keys
            todo = keyed.join(missing, "key", "left_semi").groupBy("key").agg(F.any_value(content).alias("content"))
            function(todo).select("key", "value", "error", F.lit(label).alias("run")).write.parquet(part)
        total = wanted.count()
        failed = self.spark.read.schema(_RESULTS).parquet(part).where("error is not null").count() if n else 0
        self.metrics.rows.append({"step": step, "run": label, "inputs": total, "reused": total - n, "computed": n, "failed": failed, "seconds": time.monotonic() - began})
        return keyed.join(self.results(step), "key", "left").drop("key")
