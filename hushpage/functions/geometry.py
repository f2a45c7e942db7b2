"""Bounding-box arithmetic as Columns; a box is four Columns x, y, width, height."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    width: Column
    height: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """The box in the columns x, y, width, height, each after ``prefix`` (such as "a.")."""
        return cls(*(F.col(prefix + c) for c in ("x", "y", "width", "height")))

    @classmethod
    def field(cls, value: Column) -> Box:
        return cls(*(value[c] for c in ("x", "y", "width", "height")))


def js_round(value: Column) -> Column:
    """Half up, negative halves included: floor(value + 0.5)."""
    return F.floor(value + 0.5).cast("double")


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def is_valid_box(b: Box) -> Column:
    """Four finite numbers and a positive size; NaN would pass a plain comparison."""
    ok = _finite(b.x) & _finite(b.y) & _finite(b.width) & _finite(b.height) & (b.width > 0) & (b.height > 0)
    return F.coalesce(ok, F.lit(False))


def area(b: Box) -> Column:
    return b.width * b.height


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x + a.width, b.x + b.width) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.height, b.y + b.height) - F.greatest(a.y, b.y)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Box, b: Box, shared: Column | None = None) -> Column:
    """Intersection over union; 0 for boxes without area. ``shared``: the intersection, where it is a column already; so in all that follow."""
    shared = intersection(a, b) if shared is None else shared
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def max_overlap(a: Box, b: Box, shared: Column | None = None) -> Column:
    """Intersection over the smaller area."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, (intersection(a, b) if shared is None else shared) / least).otherwise(F.lit(0.0))


def share_inside(target: Box, container: Box, shared: Column | None = None) -> Column:
    """Share of the target's area inside the container."""
    shared = intersection(target, container) if shared is None else shared
    return F.when(area(target) > 0, shared / area(target)).otherwise(F.lit(0.0))


def covers(detection: Box, element: Box, least_iou=0.2, of_detection=0.5, of_element=0.25, shared: Column | None = None) -> Column:
    """Whether a detection and an element coincide: by IoU, or by covering enough of both."""
    both = (share_inside(detection, element, shared) >= of_detection) & (share_inside(element, detection, shared) >= of_element)
    return (iou(detection, element, shared) >= least_iou) | both


def rounded(b: Box, image_width: float | None = None, image_height: float | None = None) -> Box:
    """Rounded place, not negative, and rounded size, at least 1, each by itself; clamped to an image if given."""
    x, y = F.greatest(F.lit(0.0), js_round(b.x)), F.greatest(F.lit(0.0), js_round(b.y))
    w, h = F.greatest(F.lit(1.0), js_round(b.width)), F.greatest(F.lit(1.0), js_round(b.height))
    if image_width:
        x = F.least(x, F.lit(float(image_width)))
        w = F.least(w, F.lit(float(image_width)) - x)
    if image_height:
        y = F.least(y, F.lit(float(image_height)))
        h = F.least(h, F.lit(float(image_height)) - y)
    return Box(x, y, w, h)


def union_box(a: Box, b: Box, image_width: float | None = None, image_height: float | None = None) -> Box:
    """The enclosing box, rounded and clamped."""
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    right, bottom = F.greatest(a.x + a.width, b.x + b.width), F.greatest(a.y + a.height, b.y + b.height)
    return rounded(Box(x, y, right - x, bottom - y), image_width, image_height)


def pixel_extent(b: Box, width: Column, height: Column) -> Column:
    """Struct (x0, y0, x1, y1) of the pixels that a box touches inside an image; empty if x0 >= x1 or y0 >= y1."""
    return F.struct(
        F.greatest(F.lit(0), F.floor(b.x)).cast("long").alias("x0"),
        F.greatest(F.lit(0), F.floor(b.y)).cast("long").alias("y0"),
        F.least(width, F.ceil(b.x + b.width)).cast("long").alias("x1"),
        F.least(height, F.ceil(b.y + b.height)).cast("long").alias("y1"),
    )


def snapped(value: Column) -> Column:
    """Rounded to a tenth, as measured boxes are."""
    return F.floor(value * 10 + 0.5) / 10
