"""Sinks: upserts, replacements, deletions and logs of tables in Parquet.

A published table is a folder of versions and one small file that names the one in
force. ``publish`` writes a whole version and then replaces that file in one rename:
readers see the old or the new version at every moment, and a job that dies leaves
the old one. A version that was in force stays for readers that have opened it, until
the next but one is published.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_POINTER = "CURRENT"


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, root, jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.getFileSystem(conf).makeQualified(root).toUri(), conf), root.getFileSystem(conf)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version in force, or None before the first."""
    jvm, root, _, fs = _store(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(root, _POINTER)
    if not fs.exists(pointer):
        return None
    with_name = jvm.org.apache.commons.io.IOUtils.toString(fs.open(pointer), "UTF-8").strip()
    return f"{path.rstrip('/')}/{with_name}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The published rows."""
    found = current(spark, path)
    if found is None:
        raise FileNotFoundError(f"no version of {path} is published")
    return spark.read.parquet(found)


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a version, then let the pointer name it."""
    spark = df.sparkSession
    before = current(spark, path)
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path.rstrip('/')}/{version}")
    jvm, root, context, fs = _store(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(root, f".{_POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(root, _POINTER), options)
    kept = {version, (before or "").rpartition("/")[2]}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in kept and name < version:
            fs.delete(status.getPath(), True)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of each key the row with the highest version."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones of other keys."""
    return old.join(new.select(*keys).dropDuplicates(), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones of other keys."""
    return old.unionByName(new.join(old.select(*keys).dropDuplicates(), keys, "left_anti"))


def replace_group(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """All rows of the groups that come anew are replaced."""
    return upsert(old, new, group)


def append_after(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New rows numbered on from the highest number of their key."""
    top = old.groupBy(key).agg(F.max(order).alias("_top"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    placed = new.join(top, key, "left").withColumn(order, F.coalesce("_top", F.lit(-1)) + n).drop("_top")
    return old.unionByName(placed)


def update_known(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values that come and aren't null replace those that were."""
    c = changes.select(key, *(F.col(x).alias(f"_n_{x}") for x in columns))
    out = old.join(c, key, "left")
    return out.withColumns({x: F.coalesce(f"_n_{x}", x) for x in columns}).drop(*(f"_n_{x}" for x in columns))


def supersede(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Every revision but the last of a key is superseded by the next."""
    nxt = F.lead(version).over(Window.partitionBy(key).orderBy(version))
    return rows.withColumn("superseded_by", nxt).withColumn("status", F.when(nxt.isNotNull(), "superseded").otherwise("active"))


def delete_keys(rows: DataFrame, gone: DataFrame, on: Column | str) -> DataFrame:
    return rows.join(gone, on, "left_anti")


def valid_uuid(text: Column) -> Column:
    """The text if it is an identifier, else null."""
    return F.when(text.rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), text)


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def append_absent(items: Column, value: Column) -> Column:
    """The array with the value at its end, unless it has it."""
    return F.when(F.array_contains(items, value), items).otherwise(F.array_append(items, value))


def audit(queries: DataFrame, text: str, answer: str, excerpt: int = 500) -> DataFrame:
    return queries.select("*", F.sha2(F.col(text).cast("binary"), 256).alias("query_hash"), F.left(answer, F.lit(excerpt)).alias("excerpt"))


def security_events(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return events.where(F.col("event_type").isin(*kinds))
