"""Boxes as Column expressions: a box is given by the prefix of its columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(p: str, x: str) -> Column:
    return F.col(f"{p}{x}")


def area(p: str = "") -> Column:
    return F.greatest(_c(p, "x1") - _c(p, "x0"), F.lit(0)) * F.greatest(_c(p, "y1") - _c(p, "y0"), F.lit(0))


def intersection(a: str, b: str) -> Column:
    w = F.least(_c(a, "x1"), _c(b, "x1")) - F.greatest(_c(a, "x0"), _c(b, "x0"))
    h = F.least(_c(a, "y1"), _c(b, "y1")) - F.greatest(_c(a, "y0"), _c(b, "y0"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: str, b: str) -> Column:
    both = intersection(a, b)
    return F.when(area(a) + area(b) - both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def intersects(a: str, b: str) -> Column:
    return (_c(a, "x0") <= _c(b, "x1")) & (_c(b, "x0") <= _c(a, "x1")) & (_c(a, "y0") <= _c(b, "y1")) & (_c(b, "y0") <= _c(a, "y1"))


def gap_squared(a: str, b: str) -> Column:
    """Square of the distance between two boxes; 0 where they touch."""
    dx = F.greatest(F.lit(0), _c(a, "x0") - _c(b, "x1"), _c(b, "x0") - _c(a, "x1"))
    dy = F.greatest(F.lit(0), _c(a, "y0") - _c(b, "y1"), _c(b, "y0") - _c(a, "y1"))
    return dx * dx + dy * dy


def position_key(step: int = 50) -> Column:
    """The box rounded to a grid, halves upwards."""
    return F.concat_ws(":", *[(F.floor(F.col(x) / step + 0.5) * step).cast("string") for x in ("x0", "y0", "x1", "y1")])


def expand(p: str, pad_x: float, pad_y: float, width: float, height: float) -> list[Column]:
    """The box padded on all sides and clamped to the page, as x0, y0, x1, y1."""
    return [
        F.greatest(F.lit(0), _c(p, "x0") - pad_x).alias("x0"),
        F.greatest(F.lit(0), _c(p, "y0") - pad_y).alias("y0"),
        F.least(F.lit(width), _c(p, "x1") + pad_x).alias("x1"),
        F.least(F.lit(height), _c(p, "y1") + pad_y).alias("y1"),
    ]


def union(a: str, b: str) -> list[Column]:
    return [f(_c(a, x), _c(b, x)).alias(x) for f, x in ((F.least, "x0"), (F.least, "y0"), (F.greatest, "x1"), (F.greatest, "y1"))]


def ordered(p: str = "") -> list[Column]:
    """A box given by any two opposite corners, with x0 <= x1 and y0 <= y1."""
    return [f(_c(p, f"{x}0"), _c(p, f"{x}1")).alias(f"{x}{i}") for i, f in ((0, F.least), (1, F.greatest)) for x in "xy"]


def center_distance(a: str, b: str) -> Column:
    """Distance of two boxes' centers."""
    middle = lambda p, x: _c(p, f"{x}0") + F.greatest(_c(p, f"{x}1") - _c(p, f"{x}0"), F.lit(0)) / 2
    dx, dy = middle(a, "x") - middle(b, "x"), middle(a, "y") - middle(b, "y")
    return F.sqrt(dx * dx + dy * dy)


def clamp(value: Column, least: Column, most: Column) -> Column:
    return F.least(most, F.greatest(least, value))


def covered_share(a: str, b: str) -> Column:
    """The share of box a that lies in box b, an area below 1 counted as 1."""
    own = F.greatest(F.lit(1), (_c(a, "x1") - _c(a, "x0")) * (_c(a, "y1") - _c(a, "y0")))
    return clamp(intersection(a, b) / own, F.lit(0.0), F.lit(1.0))
