"""Filters over a curve: windows of rows by series, all within whole-stage or window code."""

from __future__ import annotations

import json
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.functions.geometry import clip01, num


def series(*keys: str, order: str = "idx"):
    return W.partitionBy(*keys).orderBy(order)


def _odd(width: int) -> None:
    if width < 1 or width % 2 == 0:
        raise ValueError("the width must be odd")


def _edged(value: Column, w, width: int) -> list[Column]:
    """The values around each row, the ends repeated."""
    half = width // 2
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value).over(full), F.last(value).over(full)
    before = [F.coalesce(F.lag(value, k).over(w), first) for k in range(half, 0, -1)]
    return [*before, value, *[F.coalesce(F.lead(value, k).over(w), last) for k in range(1, half + 1)]]


def median_filter(value: Column, w, width: int = 3) -> Column:
    """Sliding median with the ends repeated; an even width counts as the next odd one."""
    width += 1 - width % 2
    if width == 3:
        a, b, c = _edged(value, w, 3)
        return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return F.element_at(F.array_sort(F.array(*_edged(value, w, width))), width // 2 + 1)


def smooth_edge(value: Column, w, width: int = 3) -> Column:
    """Moving average with the ends repeated. Even widths give a value too many and are refused. Values are added by size,
    so stretches of the same values tie."""
    _odd(width)
    return F.aggregate(F.array_sort(F.array(*_edged(value, w, width))), num(0), lambda total, x: total + x) / width


def smooth_zero(value: Column, w, width: int = 9) -> Column:
    """Moving average with zeros beyond the ends."""
    _odd(width)
    return F.sum(value).over(w.rowsBetween(-(width // 2), width // 2)) / width


def savgol_weights(width: int, order: int) -> list[list[float]]:
    """Row p: what the fitted polynomial at place p of a stretch of width values takes of each (exact fractions)."""
    places = [Fraction(i - width // 2) for i in range(width)]
    normal = [[sum(x ** (i + j) for x in places) for j in range(order + 1)] for i in range(order + 1)]
    # inverse by elimination on fractions
    rows = [r + [Fraction(int(i == j)) for j in range(order + 1)] for i, r in enumerate(normal)]
    for i in range(order + 1):
        pivot = rows[i][i]
        rows[i] = [x / pivot for x in rows[i]]
        for k in range(order + 1):
            if k != i:
                rows[k] = [a - rows[k][i] * b for a, b in zip(rows[k], rows[i])]
    inverse = [r[order + 1 :] for r in rows]
    out = []
    for p in places:
        lead = [sum(inverse[i][j] * p**i for i in range(order + 1)) for j in range(order + 1)]
        out.append([float(sum(lead[j] * x**j for j in range(order + 1))) for x in places])
    return out


def savgol(df: DataFrame, value: str, out: str, keys: list[str], width: int = 11, order: int = 2, average: int = 9, idx: str = "idx") -> DataFrame:
    """Polynomial smoothing, its ends by the polynomial of the outermost stretch, held to [0, 1]. A series shorter than
    width takes its own (odd) length; one too short for the order is averaged. idx counts from 0."""
    width = max(3, width) + (1 - max(3, width) % 2)
    w = series(*keys, order=idx)
    v, i = F.col(value), F.col(idx)
    sizes = list(range(3 if order < 3 else order + 1 + order % 2, width + 1, 2))
    # the weights of every size and place in a stretch: a constant that rows look up
    table = F.from_json(F.lit(json.dumps([savgol_weights(m, order) for m in sizes])), "array<array<array<double>>>")
    near = F.collect_list(F.struct(v.cast("double").alias("v"))).over(w.rowsBetween(-(width - 1), width - 1))
    df = df.withColumns({"_n": F.count("*").over(W.partitionBy(*keys)), "_near": near, "_flat": smooth_zero(v, w, average)})
    # each row's stretch begins where a full one fits
    df = df.withColumn("_m", F.least(F.lit(width), F.col("_n") - 1 + F.col("_n") % 2).cast("int"))
    begin = F.greatest(F.lit(0), F.least(i - F.floor(F.col("_m") / 2), F.col("_n") - F.col("_m")))
    df = df.withColumn("_at", (i - begin).cast("int"))
    here = F.least(i, F.lit(width - 1)).cast("int")
    stretch = F.slice("_near", here - F.col("_at") + 1, F.greatest(F.lit(0), F.col("_m")))
    weights = F.get(F.get(table, ((F.col("_m") - sizes[0]) / 2).cast("int")), F.col("_at"))
    fitted = F.aggregate(F.zip_with(stretch, weights, lambda x, k: x["v"] * k), num(0), lambda acc, x: acc + x)
    fitted = F.when(F.col("_m") >= sizes[0], fitted)
    return df.withColumn(out, clip01(F.coalesce(fitted, F.col("_flat")))).drop("_n", "_near", "_flat", "_m", "_at")


def local_peak(value: Column, w) -> Column:
    """At least as high as both neighbours; beyond the ends lies minus infinity."""
    low = num(float("-inf"))
    return (value >= F.coalesce(F.lag(value).over(w), low)) & (value >= F.coalesce(F.lead(value).over(w), low))


def with_median(df: DataFrame, value: str, keys: list[str], med: str = "med", off: str = "off") -> DataFrame:
    """Adds the median of each key and the distance of each value from it, within one shuffle."""
    x = df.withColumn(med, F.percentile(value, F.lit(0.5)).over(W.partitionBy(*keys)))
    return x.withColumn(off, F.abs(F.col(value) - F.col(med)))


def robust_stats(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, med, mad and sigma = 1.4826 mad."""
    off = with_median(df.select(*keys, value), value, keys)
    return off.groupBy(*keys).agg(F.first("med").alias("med"), F.percentile("off", F.lit(0.5)).alias("mad")).withColumn("sigma", F.col("mad") * 1.4826)


def robust_unit(df: DataFrame, value: str, out: str, keys: list[str]) -> DataFrame:
    """(value - median) / sigma, from 0, over its 95th percentile, held to [0, 1]."""
    w = W.partitionBy(*keys)
    x = with_median(df, value, keys, "_m", "_o")
    sigma = F.greatest(num(1e-6), F.percentile("_o", F.lit(0.5)).over(w) * 1.4826)
    x = x.withColumn("_s", sigma).withColumn("_z", F.greatest(num(0), (F.col(value) - F.col("_m")) / F.col("_s")))
    x = x.withColumn("_top", F.greatest(num(1e-6), F.percentile("_z", F.lit(0.95)).over(w)))
    return x.withColumn(out, clip01(F.col("_z") / F.col("_top"))).drop("_m", "_o", "_s", "_z", "_top")


def top_share_mean(df: DataFrame, value: str, out: str, keys: list[str], share: float) -> DataFrame:
    """Mean of the ceil(n * share) largest values of each key, one at least."""
    ranked = df.withColumns({"_r": F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value))), "_n": F.count("*").over(W.partitionBy(*keys))})
    kept = ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share)))
    return kept.groupBy(*keys).agg(F.avg(value).alias(out))


def orthogonal_rows(in_dim: int, out_dim: int, seed: int = 42) -> np.ndarray:
    """out_dim orthonormal directions, the same for the same seed."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(in_dim, out_dim)))
    return q.T


def project(vector: Column, rows: np.ndarray) -> Column:
    """The vector in a fixed basis: a dot product with each row."""
    dots = [F.aggregate(F.zip_with(vector, F.lit([float(x) for x in row]), lambda a, b: a * b), num(0), lambda a, x: a + x) for row in rows]
    return F.array(*dots)
