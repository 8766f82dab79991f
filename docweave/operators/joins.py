"""Joins: by key, by place on a page, by order, by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .intervals import holding


def hydrate(hits: DataFrame, rows: DataFrame, on: Column) -> DataFrame:
    """Rows of the hits; a hit without a row is dropped."""
    return hits.join(rows, on)


def fuse(x: DataFrame, y: DataFrame, keys: list[str], rank_x: str, rank_y: str, *, k: int, w_x: float = 0.6, w_y: float = 0.4) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    part = lambda w, r: w * F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return x.join(y, keys, "full_outer").withColumn("score", part(w_x, rank_x) + part(w_y, rank_y))


def expand_pages(seed: DataFrame, blocks: DataFrame) -> DataFrame:
    """The whole text of every page that a seed stands on."""
    pages = seed.select("document_id", "page").dropDuplicates()
    text = F.expr("listagg(text, '\\n\\n') within group (order by block_order)")
    return blocks.join(pages, ["document_id", "page"], "left_semi").groupBy("document_id", "page").agg(text.alias("page_text"))


def resolve(scope: DataFrame, keys: list[DataFrame], item: str = "item") -> DataFrame:
    """``id`` of the first of several key tables (key, id) that has the item."""
    out, names = scope, []
    for i, table in enumerate(keys):
        one = table.groupBy("key").agg(F.min("id").alias(f"id{i}")).withColumnRenamed("key", item)
        out = out.join(one, item, "left")
        names.append(f"id{i}")
    return out.withColumn("id", F.coalesce(*names)).drop(*names)


def _paired(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, Column, Column]:
    other = b.select(*keys, F.col("block_order").alias("other_order"), *(F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")))
    return a.join(other, keys), G.box("x0", "y0", "x1", "y1"), G.box("o_x0", "o_y0", "o_x1", "o_y1")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], least_iou: float, least_cover: float) -> DataFrame:
    """Pairs on one page with that intersection over union, or of which the
    second lies in the first by that share."""
    both, x, y = _paired(a, b, keys)
    return both.where((G.iou(x, y) > least_iou) | (G.covered(y, x) > least_cover))


def best_overlap(a: DataFrame, b: DataFrame, keys: list[str], least_iou: float) -> DataFrame:
    """For each box of ``a`` the box of ``b`` that overlaps it most."""
    both, x, y = _paired(a, b, keys)
    value = G.iou(x, y)
    rank = F.max_by("other_order", F.struct(value.alias("v"), (-F.col("other_order")).alias("o")))
    return both.where(value >= least_iou).groupBy(*keys, "block_order").agg(rank.alias("other_order"))


def not_overlapping(a: DataFrame, b: DataFrame, keys: list[str], most_iou: float, most_cover: float) -> DataFrame:
    """Boxes of ``a`` that no box of ``b`` on the page overlaps by more."""
    both, x, y = _paired(a, b, keys)
    hit = both.where((G.iou(x, y) > most_iou) | (G.covered(x, y) > most_cover)).select(*keys, "block_order").dropDuplicates()
    return a.join(hit, [*keys, "block_order"], "left_anti")


def containing_cell(lines: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The first cell that holds the centre of each line."""
    both, x, y = _paired(lines, cells, keys)
    cx, cy = (x["x0"] + x["x1"]) / 2, (x["y0"] + x["y1"]) / 2
    inside = cx.between(y["x0"], y["x1"]) & cy.between(y["y0"], y["y1"])
    return both.where(inside).groupBy(*keys, "block_order").agg(F.min("other_order").alias("cell"))


def nearest(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The least squared distance of corners to a box of ``b`` on the page."""
    both, _, _ = _paired(a, b, keys)
    dx, dy = F.col("x0") - F.col("o_x0"), F.col("y0") - F.col("o_y0")
    return both.groupBy(*keys, "block_order").agg(F.min(dx * dx + dy * dy).alias("distance2"))


def fill_empty(left: DataFrame, right: DataFrame, on: Column, cell: str, source: str) -> DataFrame:
    """Empty cells from the other reading; filled ones stay."""
    joined = left.join(right, on, "left")
    return joined.withColumn(cell, F.when(F.trim(cell) == "", F.coalesce(F.col(source), F.col(cell))).otherwise(F.col(cell)))


def trust(rows: DataFrame, column: str, scores: dict[str, float], unknown: float) -> DataFrame:
    known = F.create_map(*(F.lit(x) for kv in scores.items() for x in kv))
    return rows.withColumn("trust", F.coalesce(known[F.col(column)], F.lit(unknown)))


def section_ranges(headings: DataFrame, open_pages: int = 10) -> DataFrame:
    """Each heading's pages: up to the page before the next one's, at least its own."""
    nxt = F.lead("page").over(Window.partitionBy("document_id").orderBy("block_order"))
    end = F.greatest(F.col("page"), F.coalesce(nxt - 1, F.col("page") + open_pages))
    return headings.select("document_id", F.col("block_order").alias("section"), F.col("page").alias("page_start"), end.alias("page_end"))


def in_section(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """The first section whose pages hold the block, without a product of a
    document's blocks and sections."""
    found = holding(blocks.select("document_id", "block_order", "page"), sections, "document_id", "page", "page_start", "page_end", F.col("section"))
    return found.select("document_id", "block_order", F.col("first").alias("section"))


def carry(blocks: DataFrame, value: Column, name: str) -> DataFrame:
    """The last value at or before each block of its document."""
    past = Window.partitionBy("document_id").orderBy("block_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn(name, F.last(value, ignorenulls=True).over(past))
