"""Pairs of boxes of a page that overlap.

Pages of few boxes pair them directly. A grid is laid over each of the others: boxes go to the cells that they touch, cells meet in an
equi-join, and a pair is reported in the cell that holds the upper left corner of its intersection, so once. Cells are as large as a page's
boxes are on average, and a page has no more cells than boxes: what a box costs is in proportion to what it can overlap, and many boxes that
hardly overlap make few pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushpage.functions.geometry import Box, intersection, is_valid_box

BOX = ("x", "y", "width", "height")


#: Boxes of a page that are paired directly: at most 2,016 pairs.
FEW = 64


def grid_of_pages(rows: DataFrame) -> DataFrame:
    """(snapshot_id, boxes, left, top, cell_width, cell_height) over valid boxes."""
    wide, high = F.max(F.col("x") + F.col("width")) - F.min("x"), F.max(F.col("y") + F.col("height")) - F.min("y")
    lines = F.ceil(F.sqrt(F.count(F.lit(1))))
    return rows.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("boxes"), F.min("x").alias("left"), F.min("y").alias("top"),
        F.greatest(F.avg("width"), wide / lines).alias("cell_width"), F.greatest(F.avg("height"), high / lines).alias("cell_height"),
    )


def _cell(value: Column, start: str, size: str) -> Column:
    return F.floor((value - F.col(start)) / F.col(size))


def _in_cells(boxes: DataFrame, grid: DataFrame, name: str) -> DataFrame:
    """Boxes as structs called ``name``, a row for each cell that they touch."""
    whole = F.struct(*[F.col(c) for c in boxes.columns]).alias(name)
    across = F.sequence(_cell(F.col("x"), "left", "cell_width"), _cell(F.col("x") + F.col("width"), "left", "cell_width"))
    down = F.sequence(_cell(F.col("y"), "top", "cell_height"), _cell(F.col("y") + F.col("height"), "top", "cell_height"))
    frame = ["left", "top", "cell_width", "cell_height"]
    rows = boxes.join(grid, "snapshot_id").select("snapshot_id", whole, *frame, F.explode(across).alias("cx"), down.alias("down"))
    return rows.select("snapshot_id", name, *frame, "cx", F.explode("down").alias("cy"))


def overlapping(a: DataFrame, b: DataFrame, also: Column | None = None, few: int = FEW) -> DataFrame:
    """(a, b, shared): structs of rows of a page whose boxes share some area, and that area. Both sides have snapshot_id and a box; invalid boxes meet nothing.

    ``also`` is a further condition on the columns a and b, such as an order that keeps one of two pairs. ``few``: boxes up to which a page pairs
    them directly, in its row. A first job counts the boxes of the largest page, so that pages of either kind cost nothing where there are none.
    """
    same = a is b
    a, b = (side.where(F.col("snapshot_id").isNotNull() & is_valid_box(Box.of())) for side in (a, b))
    both = a if same else a.select("snapshot_id", *BOX).unionAll(b.select("snapshot_id", *BOX))
    grid = grid_of_pages(both)
    most = both.groupBy("snapshot_id").count().agg(F.max("count")).first()[0] or 0
    area = intersection(Box.of("a."), Box.of("b."))
    meet = lambda pairs: (pairs if also is None else pairs.where(also)).select("a", "b", area.alias("shared")).where("shared > 0")
    if most <= few:
        return meet(_in_rows(a, None if same else b))
    large = grid.where(F.col("boxes") > few)
    left, right = _in_cells(a, large, "a"), _in_cells(b, large, "b").select("snapshot_id", "cx", "cy", "b")
    corner = (_cell(F.greatest(F.col("a.x"), F.col("b.x")), "left", "cell_width") == F.col("cx")) & (_cell(F.greatest(F.col("a.y"), F.col("b.y")), "top", "cell_height") == F.col("cy"))
    gridded = meet(left.join(right, ["snapshot_id", "cx", "cy"]).where(corner))
    small = grid.where(F.col("boxes") <= few).select("snapshot_id")
    return meet(_in_rows(*(side.join(small, "snapshot_id", "left_semi") for side in (a, b)))).unionAll(gridded)


def _in_rows(a: DataFrame, b: DataFrame | None) -> DataFrame:
    """(a, b): all pairs of rows of each page, which is one row for the time being. Without ``b`` both are of one side."""
    held = lambda side, name: side.groupBy("snapshot_id").agg(F.collect_list(F.struct(*[F.col(c) for c in side.columns])).alias(name))
    pages = held(a, "all_a").withColumn("all_b", F.col("all_a")) if b is None else held(a, "all_a").join(held(b, "all_b"), "snapshot_id")
    return pages.select("all_b", F.explode("all_a").alias("a")).select("a", F.explode("all_b").alias("b"))
