"""Geometry of axis-parallel boxes as column arithmetic; a box is a tuple (x, y, w, h) of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns x, y, w, h, or p.x, ... with a prefix."""
    at = f"{prefix}." if prefix else ""
    return F.col(f"{at}x"), F.col(f"{at}y"), F.col(f"{at}w"), F.col(f"{at}h")


def to_pixels(b: Box, width: Column, height: Column) -> Column:
    """Corners (x1, y1, x2, y2) in pixels, origin at the top, of a relative box with its origin at the bottom."""
    x, y, w, h = b
    x1, y2 = x * width, (1 - y) * height
    return F.struct(x1.alias("x1"), (y2 - h * height).alias("y1"), (x1 + w * width).alias("x2"), y2.alias("y2"))


def to_plot(b: Box, width: Column, height: Column) -> Column:
    """Anchor and extent (x, y, w, h) for plotting: h is negative, as plots grow upwards."""
    x, y, w, h = b
    return F.struct((x * width).alias("x"), ((1 - y) * height).alias("y"), (w * width).alias("w"), (-(h * height)).alias("h"))


def flip_y(y: Column, h: Column, page: float | Column = 1.0) -> Column:
    """Between an origin at the top and one at the bottom of a page of that height; its own inverse."""
    return F.lit(page) - y - h if not isinstance(page, Column) else page - y - h


def from_slice(b: Box, y_start: Column, y_end: Column, page: Column) -> Box:
    """A box relative to a slice (origin at its bottom) as one relative to the whole page (origin at the top)."""
    x, y, w, h = b
    tall = y_end - y_start
    return x, (y_start + (1 - y - h) * tall) / page, w, h * tall / page


def y_center(b: Box) -> Column:
    return b[1] + b[3] / 2


def edges(b: Box) -> Column:
    """struct(top, bottom) of a box with its origin at the bottom: the upper edge has the larger y."""
    return F.struct((b[1] + b[3]).alias("top"), b[1].alias("bottom"))


def _intersection(a: Box, b: Box) -> Column:
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    wide = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    tall = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.when((wide > 0) & (tall > 0), wide * tall).otherwise(F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def overlap(a: Box, b: Box) -> Column:
    """Intersection over the smaller area: 1 for a box within another, 0 for boxes that only touch."""
    return _share(_intersection(a, b), F.least(a[2] * a[3], b[2] * b[3]))


def iou(a: Box, b: Box) -> Column:
    both = _intersection(a, b)
    return _share(both, a[2] * a[3] + b[2] * b[3] - both)


def contained(inner: Box, outer: Box, share: float = 0.8) -> Column:
    """Whether at least that share of the inner box lies in the outer one."""
    return _share(_intersection(inner, outer), inner[2] * inner[3]) >= share


def plausible_region(b: Box, width: Column, height: Column, least: float = 0.02, most: float = 0.95, slimmest: float = 0.1, widest: float = 10.0) -> Column:
    """A region of a sensible share of the picture, of sensible proportions, and within its bounds."""
    x, y, w, h = b
    share = w * h / (width * height)
    shape = F.when(h > 0, w / h).otherwise(F.lit(0.0))
    return share.between(least, most) & shape.between(slimmest, widest) & (x >= 0) & (y >= 0) & (x + w <= width) & (y + h <= height)


def shift(b: Box, dx: Column, dy: Column) -> Box:
    """A region's own pixel box on the page that the region was cut from."""
    return b[0] + dx, b[1] + dy, b[2], b[3]
