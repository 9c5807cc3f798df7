"""Boxes, points and intervals as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvetrail.config import Motion

_M = Motion()


def num(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, low: float, high: float) -> Column:
    """x held to [low, high]; a null stays null (least and greatest alone would turn it into a bound)."""
    return F.when(x.isNotNull(), F.least(num(high), F.greatest(num(low), x)))


def clip01(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def finite(x: Column) -> Column:
    """NaN, infinities and null become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == num(float("inf"))), num(0)).otherwise(x)


def sigmoid(x: Column) -> Column:
    return num(1) / (num(1) + F.exp(-clip(x, -40.0, 40.0)))


def col_of(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def point_x(p: str = "") -> Column:
    return (col_of(p, "x1") + col_of(p, "x2")) * 0.5


def point_y(p: str = "", height: float = _M.point_height) -> Column:
    """The point that motion features follow: so far down the box."""
    return col_of(p, "y1") + (col_of(p, "y2") - col_of(p, "y1")) * height


def foot_y(p: str = "") -> Column:
    """The point that refinement follows: the bottom edge."""
    return col_of(p, "y2")


def scale(area: Column) -> Column:
    return F.sqrt(F.greatest(area, num(1)))


def area_ratio(a: Column, b: Column) -> Column:
    a, b = F.greatest(a, num(1)), F.greatest(b, num(1))
    return F.greatest(a, b) / F.least(a, b)


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...], floor: bool = False) -> Column:
    """Intersection over union + 1e-6; with floor, over the union but at least 1e-6."""
    w = F.greatest(num(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(num(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    size = lambda x: F.greatest(num(0), x[2] - x[0]) * F.greatest(num(0), x[3] - x[1])
    union = size(a) + size(b) - w * h
    return w * h / (F.greatest(num(1e-6), union) if floor else union + 1e-6)


def box(p: str = "") -> tuple[Column, ...]:
    return tuple(col_of(p, n) for n in ("x1", "y1", "x2", "y2"))


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Of closed integer intervals."""
    inter = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    union = (e1 - s1 + 1) + (e2 - s2 + 1) - inter
    return inter / F.greatest(F.lit(1), union)


def diagonal(w: Column, h: Column) -> Column:
    return F.greatest(num(1), F.hypot(w, h))


def edge_unstable(p: str, w: Column, h: Column, ratio: float = _M.edge_ratio) -> Column:
    """Some side of the box is within a share of the diagonal from the frame's edge."""
    margin = diagonal(w, h) * ratio
    x1, y1, x2, y2 = box(p)
    return (x1 <= margin) | (y1 <= margin) | (x2 >= w - margin) | (y2 >= h - margin)


def edge_distance(x: Column, y: Column, w: Column, h: Column) -> Column:
    x, y = F.least(F.greatest(x, num(0)), w), F.least(F.greatest(y, num(0)), h)
    return F.least(x, w - x, y, h - y)


def far_score(x: Column, y: Column, w: Column, h: Column, low: float = _M.far_from, high: float = _M.far_to) -> Column:
    """0 near the frame's edge up to 1 well inside."""
    return clip01((edge_distance(x, y, w, h) / diagonal(w, h) - low) / (high - low))


def box_at(px: Column, py: Column, w: Column, h: Column, height: float = _M.point_height) -> tuple[Column, ...]:
    """The box of size w x h whose followed point is (px, py)."""
    return px - w / 2, py - h * height, px + w / 2, py + h - h * height


def bround(x: Column) -> Column:
    return F.bround(x, 0)


def color_channel(track: Column, factor: int, shift: int = 0) -> Column:
    return F.pmod(track * factor + shift, F.lit(255))


def weighted_sum(weights: dict[str, float], columns: list[str]) -> Column:
    """Sum of weight times column over positive weights; absent or null columns count 0."""
    total = num(0)
    for name, weight in weights.items():
        if weight > 0 and name in columns:
            total = total + F.coalesce(F.col(name), num(0)) * weight
    return total


def top_mean(values: Column, k: int) -> Column:
    """Mean of the k largest of an array (all, if fewer); 0 for an empty or null one."""
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    total = F.aggregate(top, num(0), lambda a, x: a + x)
    return F.when(F.size(F.coalesce(values, F.array().cast("array<double>"))) > 0, total / F.size(top)).otherwise(num(0))


def exact_mean(value: Column) -> Column:
    """Mean of a group whatever the order of its rows: decimals of 16 places are added and divided, so equal means compare
    as equal. A group with a value from 1e13 on, infinite or NaN takes the usual mean."""
    plain = F.abs(value) < 1e13
    return F.when(F.bool_and(plain), F.avg(F.when(plain, value.cast("decimal(30,16)"))).cast("double")).otherwise(F.avg(value))


def upper_median(values: Column) -> Column:
    """Of a sorted array the element at n div 2."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def resize_plan(w: Column, h: Column, longest: int) -> tuple[Column, Column]:
    """Dimensions after the longer side is brought down to longest (half to even); smaller frames stay."""
    side = F.greatest(w, h)
    ratio = num(longest) / side
    small = lambda x: F.when(side <= longest, x.cast("long")).otherwise(F.greatest(F.lit(1), bround(x * ratio)).cast("long"))
    return small(w), small(h)
