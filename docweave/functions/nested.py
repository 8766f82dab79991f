"""Nested values of any shape: canonical texts, and settings by path, with VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: levels of nesting that settings are followed; what lies deeper stays one value
DEPTH = 8


def canonical(json_text: Column) -> Column:
    """A JSON text without white space and with the keys of every object in order,
    at any depth (a VARIANT keeps its fields sorted); null where it is no JSON.
    Equal arguments have equal texts, in whatever order their keys came."""
    return F.to_json(F.try_parse_json(json_text))


def call_key(name: Column, json_text: Column) -> Column:
    """A call's name and arguments as one key; no arguments are an empty object."""
    return F.concat_ws(":", name, canonical(F.coalesce(json_text, F.lit("{}"))))


def approved(calls: DataFrame, allowed: DataFrame, name: str, args: str) -> DataFrame:
    """``calls`` with ``approved``: an allowed call has the same name and the same
    arguments. What is no JSON is never approved."""
    keys = allowed.select(call_key(F.col(name), F.col(args)).alias("_key")).where("_key is not null").dropDuplicates().withColumn("_hit", F.lit(True))
    keyed = calls.withColumn("_key", F.when(canonical(F.coalesce(F.col(args), F.lit("{}"))).isNotNull(), call_key(F.col(name), F.col(args))))
    return keyed.join(keys, "_key", "left").withColumn("approved", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")


def flat_settings(rows: DataFrame, id_col: str, json_col: str, depth: int = DEPTH) -> DataFrame:
    """id, path, value: the leaves of each row's nested settings, by path
    (``a.b[0]``), values as JSON texts; empty objects and arrays are leaves. Each
    level is one ``variant_explode``, and only what is nested goes on to the next."""
    level = rows.select(F.col(id_col).alias("id"), F.lit("").alias("path"), F.try_parse_json(json_col).alias("v")).where("v is not null")
    out: DataFrame | None = None
    for k in range(depth + 1):
        kind = F.schema_of_variant("v")
        nested = (F.startswith(kind, F.lit("OBJECT<")) & (F.to_json("v") != "{}")) | (F.startswith(kind, F.lit("ARRAY<")) & (F.to_json("v") != "[]"))
        told = (level if k == depth else level.where(~nested)).select("id", "path", F.to_json("v").alias("value"))
        out = told if out is None else out.unionByName(told)
        if k < depth:
            step = level.where(nested).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
            name = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), F.col("key")))
            level = step.select("id", name.alias("path"), F.col("value").alias("v"))
    return out


def apply_settings(flat: DataFrame, changes: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """``flat`` with the values of ``changes`` (id, path, value) in place of its own.
    A path that isn't there is added if it is ``optional`` and else left out; of
    several changes of one path the largest value in order stays."""
    last = changes.groupBy("id", "path").agg(F.max("value").alias("_new"))
    both = flat.withColumn("_old", F.lit(True)).join(last, ["id", "path"], "full_outer")
    kept = both.where(F.col("_old") | F.col("path").isin(*optional)) if optional else both.where("_old")
    return kept.select("id", "path", F.coalesce("_new", "value").alias("value"))
