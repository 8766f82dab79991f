"""Cutting lineage with tables in the shared folder, and giving their space back.

The folder is what the session names in ``spark.checkpoint.dir``; only where
that is unset (tests on one machine) a temporary folder is made.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


#: folders made for sessions that name none, by application
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme, so that
    Spark and other readers mean the same store."""
    sc = spark.sparkContext
    found = sc.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        found = _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="docweave-"))
    p = sc._jvm.org.apache.hadoop.fs.Path(found)
    full = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/docweave/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Unlike ``checkpoint()`` it computes the rows once; a lost executor costs
    nothing afterwards, as the files do not live on executors.
    """
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._docweave_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no later step reads, and let
    Spark drop the shuffle files of plans that are gone."""
    spark = None
    for df in frames:
        spark, path = df.sparkSession, getattr(df, "_docweave_path", None)
        if path:
            remove(spark, path)
    if spark is not None:
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
