"""Pairs of boxes that may touch, by a grid over the frame.

A box is dealt to the cells that it covers, so boxes meet only where they are near each other: the work is linear in boxes
that are spread out, where all pairs of a frame would be its square. A pair that shares several cells counts in the one
where the common part of the two boxes begins. What lies outside the frame falls to the cells at its rim, so a box has at
most (GRID + 2) squared cells, whatever its size. Where frames are known to hold few boxes, a frame is one cell: a row for
each cell of a box costs more than the pairs that it saves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvetrail.functions.geometry import box_iou

#: Cells across and down a frame.
GRID = 16
#: Boxes of a frame up to which it is one cell.
FEW = 256
SIDES = ("x1", "y1", "x2", "y2")


def _place(v: Column, side: Column) -> Column:
    return F.least(F.lit(GRID), F.greatest(F.lit(-1), F.floor(v * GRID / side))).cast("int")


def cell_at(x: Column, y: Column, fw: Column, fh: Column, few: Column | None = None) -> Column:
    """The number of the cell at a point; 0 where the frame is one cell (few)."""
    cell = (_place(y, fh) + 1) * (GRID + 2) + _place(x, fw) + 1
    return cell if few is None else F.when(few, F.lit(0)).otherwise(cell)


def cells(x1: Column, y1: Column, x2: Column, y2: Column, fw: Column, fh: Column, few: Column | None = None) -> Column:
    """The numbers of the cells that a box covers, its borders included."""
    across = F.sequence(_place(F.least(x1, x2), fw), _place(F.greatest(x1, x2), fw))
    down = F.sequence(_place(F.least(y1, y2), fh), _place(F.greatest(y1, y2), fh))
    covered = F.flatten(F.transform(down, lambda j: F.transform(across, lambda i: (j + 1) * (GRID + 2) + i + 1)))
    return covered if few is None else F.when(few, F.array(F.lit(0))).otherwise(covered)


def overlapping_pairs(boxes: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Pairs (keys, a, b: the smaller and the larger of column key, iou) of boxes that overlap. boxes: keys, key, x1, y1, x2,
    y2, fw, fh (the frame, positive) and few, if there is such a column: whether the frame is to be one cell, the same in a
    group; key tells the boxes of a group apart."""
    frame = [c for c in ("fw", "fh", "few") if c in boxes.columns]
    dealt = boxes.select(*keys, F.col(key).alias("a"), *SIDES, *frame, F.explode(cells(*map(F.col, (*SIDES, *frame)))).alias("cell"))
    other = dealt.select(*keys, F.col("a").alias("b"), *[F.col(c).alias(f"o_{c}") for c in SIDES], "cell")
    left, top = F.greatest("x1", "o_x1"), F.greatest("y1", "o_y1")
    met = dealt.join(other, [*keys, "cell"]).where((F.col("a") < F.col("b")) & (F.least("x2", "o_x2") > left) & (F.least("y2", "o_y2") > top))
    met = met.where(F.col("cell") == cell_at(left, top, *map(F.col, frame)))
    return met.select(*keys, "a", "b", box_iou(tuple(map(F.col, SIDES)), tuple(F.col(f"o_{c}") for c in SIDES)).alias("iou"))
