"""Folders that the driver and all executors share, and rows dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's address under ``spark.checkpoint.dir``; only on one machine,
    and where that is unset, under a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="docweave-"))
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    full = full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    return f"{full}/docweave/{kind}-{uuid.uuid4().hex}"


def write_file(folder: str, name: str, content: bytes) -> str:
    """Write one file under a name of its own first, so that no reader sees half
    of it and a repeated task replaces it."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, f"{base}/{name}")
    return f"{folder}/{name}"


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table in fewer partitions than there are cores, dealt to all of
    them; a larger table stays as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
