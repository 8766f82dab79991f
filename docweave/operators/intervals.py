"""Points in intervals without a product of both sides.

An interval of whole numbers is a union of dyadic blocks, at most two of each size;
a point lies in one block of each size. So "which intervals hold a point" is a join
on (group, size, block), and what is asked of the intervals is aggregated by block
before the join. Rows grow with the number of levels (the logarithm of the longest
interval), never with the product; a long group spreads over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dyadic_blocks(low: Column, high: Column, levels: int) -> Column:
    """Array of (level, block) that together are low..high; empty if high < low.
    Levels from 0 to ``levels``; the last takes as many blocks as are left."""
    block = lambda level, x: F.struct(level.cast("int").alias("level"), x.cast("long").alias("block"))
    start = F.struct(low.cast("long").alias("a"), (high.cast("long") + 1).alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        left, right = (a < b) & (a % 2 != 0), (a < b) & (b % 2 != 0)
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        a2 = F.when(left, a + 1).otherwise(a)
        right = right & (a2 < b)
        out = F.concat(s["out"], F.when(left, F.array(block(level, a))).otherwise(none), F.when(right, F.array(block(level, b - 1))).otherwise(none))
        b2 = F.when(right, b - 1).otherwise(b)
        return F.struct(F.shiftright(a2, 1).alias("a"), F.shiftright(b2, 1).alias("b"), out.alias("out"))

    def last(s: Column) -> Column:
        rest = F.when(s["a"] < s["b"], F.transform(F.sequence(s["a"], s["b"] - 1), lambda x: block(F.lit(levels), x))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
        return F.concat(s["out"], rest)

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step, last)


def holding(points: DataFrame, intervals: DataFrame, group: str, point: str, low: str, high: str, value: Column, *, levels: int = 20) -> DataFrame:
    """``points`` with ``first``: the least ``value`` of the intervals of their group
    that hold them (rows that none holds go)."""
    cover = intervals.select(group, value.alias("first"), F.explode(dyadic_blocks(F.col(low), F.col(high), levels)).alias("at"))
    best = cover.groupBy(group, F.col("at.level").alias("level"), F.col("at.block").alias("block")).agg(F.min("first").alias("first"))
    keyed = points.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.call_function("shiftright", F.col(point).cast("long"), k))).alias("level", "block"))
    names = points.columns
    hit = keyed.join(best, [group, "level", "block"])
    return hit.groupBy(*names).agg(F.min("first").alias("first"))


def counts_within(points: DataFrame, intervals: DataFrame, group: str, point: str, low: str, high: str, name: str = "n") -> DataFrame:
    """``intervals`` with the number of points of their group that they hold:
    one sort of points and ends together and a running sum, no product."""
    marks = points.groupBy(group, F.col(point).cast("long").alias("at")).agg(F.count("*").alias("points"))
    marks = marks.select(group, "at", F.lit(0).alias("kind"), "points")
    own = F.struct(*intervals.columns)
    ends = [intervals.select(group, at.cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("points"), own.alias("own"), F.lit(sign).alias("sign")) for at, sign in ((F.col(high), 1), (F.col(low) - 1, -1))]
    marks = marks.withColumns({"own": F.lit(None).cast(ends[0].schema["own"].dataType), "sign": F.lit(0)})
    sweep = Window.partitionBy(group).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = marks.unionByName(ends[0]).unionByName(ends[1]).withColumn("sum", F.sum("points").over(sweep)).where("kind = 1")
    # equal intervals are one group here, and come back as often as they stood there
    counted = run.groupBy("own").agg(F.sum(F.col("sum") * F.col("sign")).alias("total"), F.count_if(F.col("sign") == 1).alias("times"))
    each = counted.select("own", F.floor(F.col("total") / F.col("times")).alias(name), F.explode(F.sequence(F.lit(1), F.col("times"))))
    return each.select("own.*", name)
