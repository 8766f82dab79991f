"""Ranking, rolling windows, packing, duplicates and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return ranked(rows, by, order).where(F.col("rank") <= n)


def rolling_sum(events: DataFrame, key: str, ts: str, value: str, minutes: int, name: str = "rolling") -> DataFrame:
    """Sum of the last minutes, each event's own moment included."""
    span = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-minutes * 60_000_000, 0)
    return events.withColumn(name, F.sum(value).over(span))


def pack_prefix(rows: DataFrame, by: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Best first until the first row that goes over the budget; a first row
    that is alone too large stays, marked as cut."""
    w = Window.partitionBy(*by).orderBy(*order)
    used = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumns({"rank": F.row_number().over(w).cast("long"), "used": used})
    fits = F.min((F.col("used") <= budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("fits", fits).where("fits = 1 or rank = 1").withColumn("cut", F.col("fits") == 0).drop("fits")


def pack_greedy(rows: DataFrame, by: list[str], order: list[Column], tokens: str, budget: int, item: str) -> DataFrame:
    """Best first, each that still fits; those that don't are passed over. A group
    streams through its task; what is held of it is what was taken."""

    def step(state: dict, row: tuple) -> tuple:
        name, size = row
        if state["used"] + size <= budget:
            state["used"] += size
            state["taken"].append(name)
        else:
            state["dropped"] += 1
        return ()

    kind = rows.schema[item].dataType.simpleString()
    sized = rows.withColumn("_tokens", F.col(tokens).cast("long"))
    return fold(sized, by, order, [item, "_tokens"], lambda: {"used": 0, "taken": [], "dropped": 0}, step, f"used long, taken array<{kind}>, dropped long", lambda s: [(s["used"], s["taken"], s["dropped"])])


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in the order."""
    return top(rows, keys, order, 1).drop("rank")


def with_verbatim(subs: Column, question: Column, max_chars: int = 500) -> Column:
    """The sub-questions, with the question itself at the end unless one of them
    says the same (but for case and outer spaces) or it is too long."""
    said = F.exists(subs, lambda q: F.lower(F.trim(q)) == F.lower(F.trim(question)))
    return F.when(said | (F.length(question) > max_chars), subs).otherwise(F.array_append(subs, question))


def merged_boxes(boxes: list[list[float]], least_iou: float = 0.3) -> list[list[float]]:
    """In the given order each box takes in those after it that overlap what it
    has grown to; this goes on until nothing changes."""

    def overlap(a: list[float], b: list[float]) -> float:
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        return inter / union if union > 0 else 0.0

    before = None
    while before != len(boxes):
        before, rest, boxes = len(boxes), boxes, []
        while rest:
            (box, *others), rest = rest, []
            for other in others:
                if overlap(box, other) > least_iou:
                    box = [*map(min, box[:2], other[:2]), *map(max, box[2:], other[2:])]
                else:
                    rest.append(other)
            boxes.append(box)
    return boxes


def merge_boxes(boxes: DataFrame, keys: list[str], order: str, least_iou: float = 0.3) -> DataFrame:
    """Boxes of a page (in the order of ``order``) that overlap become one, until
    none do. Pages stream through their tasks; one page's boxes are held."""
    sides = ["x0", "y0", "x1", "y1"]
    whole = boxes.select(*(F.col(k).cast("long").alias(k) for k in keys), order, *sides)
    merged = lambda page: [tuple(map(int, b)) for b in merged_boxes(page, least_iou)]
    return fold(whole, keys, [order, *sides], sides, list, lambda page, box: page.append(list(box)) or (), ", ".join(f"{c} long" for c in sides), merged)
