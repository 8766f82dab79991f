"""Boxes and table shapes, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import half_width


def box(x0: str, y0: str, x1: str, y1: str) -> Column:
    return F.struct(*(F.col(c).cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return wide * high


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes without area."""
    union = area(a) + area(b) - overlap(a, b)
    return F.when(union > 0, overlap(a, b) / union).otherwise(F.lit(0.0))


def covered(a: Column, b: Column) -> Column:
    """Share of ``a`` that lies in ``b``."""
    return F.when(area(a) > 0, overlap(a, b) / area(a)).otherwise(F.lit(0.0))


def _of(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def normalised(b: Column, width: float, height: float) -> Column:
    """In shares of the page, rounded; null for a box out of order, out of the
    page, or a sliver (thinner than 0.001 and 40 times as long)."""
    x0, x1, y0, y1 = b["x0"] / width, b["x1"] / width, b["y0"] / height, b["y1"] / height
    w, h = x1 - x0, y1 - y0
    sliver = (F.least(w, h) < 0.001) & (F.greatest(w, h) > 40 * F.least(w, h))
    good = (x0 >= 0) & (y0 >= 0) & (x1 <= 1) & (y1 <= 1) & (w > 0) & (h > 0) & ~sliver
    return F.when(good, _of(*(F.round(v, 6) for v in (x0, y0, x1, y1))))


def remap(b: Column, left: float, top: float, sx: float, sy: float) -> Column:
    """A box of a tile as one of the page."""
    return _of(left + b["x0"] * sx, top + b["y0"] * sy, left + b["x1"] * sx, top + b["y1"] * sy)


def from_bottom(b: Column, height: float) -> Column:
    """A box measured from the bottom as one measured from the top."""
    return _of(b["x0"], height - b["y1"], b["x1"], height - b["y0"])


def padded(b: Column, pad: tuple[float, float, float, float], width: float, height: float) -> Column:
    zero = F.lit(0.0)
    return _of(F.greatest(zero, b["x0"] - pad[0]), F.greatest(zero, b["y0"] - pad[1]), F.least(F.lit(width), b["x1"] + pad[2]), F.least(F.lit(height), b["y1"] + pad[3]))


def halves(b: Column, share: float) -> Column:
    """Upper and lower half, which overlap by a share of the height."""
    h = b["y1"] - b["y0"]
    top = _of(b["x0"], b["y0"], b["x1"], b["y0"] + h * (0.5 + share / 2))
    low = _of(b["x0"], b["y0"] + h * (0.5 - share / 2), b["x1"], b["y1"])
    return F.struct(top.alias("top"), low.alias("low"))


def tiles(pages: DataFrame, width: int, height: int, nx: int, ny: int, margin: int) -> DataFrame:
    """nx by ny tiles of every page, each wider by ``margin`` on its inner sides."""
    at = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grid = pages.select("*", at(ny).alias("tile_y")).select("*", at(nx).alias("tile_x"))
    w, h = width // nx, height // ny
    zero = F.lit(0).cast("long")
    return grid.select(
        "*",
        F.greatest(zero, F.col("tile_x") * w - margin).alias("x0"),
        F.greatest(zero, F.col("tile_y") * h - margin).alias("y0"),
        F.least(F.lit(width).cast("long"), F.col("tile_x") * w + w + margin).alias("x1"),
        F.least(F.lit(height).cast("long"), F.col("tile_y") * h + h + margin).alias("y1"),
    )


def tile_count(pixels: Column, limit: int, most: int) -> Column:
    return F.least(F.lit(most), F.ceil(pixels / limit)).cast("long")


def page_class(drawing: Column, large: Column, scanned: Column) -> Column:
    return F.when(drawing, "diagram").when(large, "large_format").when(scanned, "scanned").otherwise("text")


# ---------------------------------------------------------------- tables


def header_anomaly(headers: Column) -> Column:
    """Names that stand twice, or blank ones."""
    filled = F.filter(headers, lambda h: F.trim(h) != "")
    return (F.size(F.array_distinct(filled)) != F.size(filled)) | (F.size(filled) != F.size(headers))


def ragged_rows(rows: Column) -> Column:
    return F.size(F.array_distinct(F.transform(rows, lambda r: F.size(r)))) > 1


def orphan_table(rows: Column) -> Column:
    return F.size(rows) <= 2


def diagram_grid(rows: Column) -> Column:
    """A drawing taken for a table: more than 45 % tiny or wordless cells."""
    cells = F.filter(F.transform(F.flatten(rows), lambda c: F.trim(c)), lambda c: c != "")
    tiny = F.size(F.filter(cells, lambda c: (F.length(c) <= 2) | c.rlike("^[\\d\\W]+$")))
    return (F.size(rows) >= 2) & (F.size(cells) >= 6) & (tiny > F.size(cells) * 0.45)


def blank_continuation(rows: Column) -> Column:
    """A row whose first cell alone is empty."""
    filled = lambda r: F.exists(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda c: F.trim(c) != "")
    return (F.size(rows) >= 2) & F.exists(rows, lambda r: (F.size(r) > 0) & (F.trim(F.get(r, 0)) == "") & filled(r))


def placeholder_headers(headers: Column) -> Column:
    """Headers that only count: 0, 1, 2 …"""
    return F.forall(F.transform(headers, lambda h, i: h == i.cast("string")), lambda same: same)


def lacks_anchor(cells: Column, lead: Column) -> Column:
    """A code (digits and a letter) of the lead-in, and none of them in the table."""
    codes = F.regexp_extract_all(half_width(lead), F.lit("\\b\\d+[a-zA-Z]\\b"), F.lit(0))
    plain = F.lower(half_width(cells))
    return (F.size(codes) > 0) & ~F.exists(codes, lambda c: F.contains(plain, F.lower(c)))
