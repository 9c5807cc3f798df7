"""Least squares over arrays of times and values.

Degrees 1 and 2 are closed forms over power sums, batches of rows at once (closed_fits). Any degree as Column expressions
goes by polynomials that are orthogonal over the given times (orthogonal_fit). The polynomials come from a three-term recurrence on times scaled to [-1, 1] and shifted by their means, so no power sums
and no system of equations arise, and high degrees stay exact. A degree that the times cannot tell from lower ones (times
that repeat, too few of them) adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from curvetrail.functions.geometry import num

#: Squared norm, as a share of the number of times, from which a polynomial counts as zero over the times.
ZERO = 1e-18


#: What closed_fits gives: value, slope and curvature term of x and y at the last time, and (p) of the fit without the
#: last observation at the time before; and the upper median of the steps between times, 1 at least.
CLOSED = [f"{p}{c}" for p in ("", "p") for c in ("x0", "vx", "qx", "y0", "vy", "qy")] + ["next_dt"]


def _last(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last `width` numbers of each list, the oldest first: numbers, which of them there are, which are null."""
    offsets = lists.offsets.to_numpy()
    at = offsets[1:, None] - np.arange(width, 0, -1)
    there = at >= offsets[:-1, None]
    at = np.where(there, at, 0)
    if not len(lists.values):
        return np.zeros(at.shape, lists.values.type.to_pandas_dtype()), there, there
    null = lists.values.is_null().to_numpy(zero_copy_only=False)[at] & there if lists.values.null_count else np.zeros_like(there)
    return lists.values.to_numpy(zero_copy_only=False)[at], there, null


def _power_sums(t: np.ndarray, x: np.ndarray, y: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
    """Power sums of times and their products with x and y: s0..s4, x0..x2, y0..y2. Added from the oldest on."""
    sums = [np.zeros(len(t)) for _ in range(11)]
    for k in range(t.shape[1]):
        on = there[:, k]
        u, a, b = (np.where(on, v[:, k], 0.0) for v in (t, x, y))
        for total, term in zip(sums, (on, u, u * u, u * u * u, u * u * u * u, a, a * u, a * u * u, b, b * u, b * u * u)):
            total += term
    return sums


def _solved(sums: list[np.ndarray], curved: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Value, slope and curvature term at time 0 of x and y, of degree 2 where curved; each with where there is none, as
    the times do not tell the degree."""
    s0, s1, s2, s3, s4 = sums[:5]
    m0, m1, m2 = s2 * s4 - s3 * s3, s1 * s4 - s2 * s3, s1 * s3 - s2 * s2
    d1, d2 = s0 * s2 - s1 * s1, s0 * m0 - s1 * m1 + s2 * m2
    none = np.where(curved, d2, d1) == 0
    out = []
    for b0, b1, b2 in (sums[5:8], sums[8:]):
        for lin, cur in (
            ((b0 * s2 - b1 * s1) / d1, (b0 * m0 - s1 * (b1 * s4 - b2 * s3) + s2 * (b1 * s3 - b2 * s2)) / d2),
            ((s0 * b1 - s1 * b0) / d1, (s0 * (b1 * s4 - b2 * s3) - b0 * m1 + s2 * (s1 * b2 - b1 * s2)) / d2),
            (np.zeros(len(b0)), (s0 * (s2 * b2 - b1 * s3) - s1 * (s1 * b2 - b1 * s2) + b0 * m2) / d2),
        ):
            out.append((np.where(curved, cur, lin), none))
    return out


def closed_fits(degree: int, hist: int) -> Callable[[Column, Column, Column], Column]:
    """A function of arrays of frame numbers, x and y (the oldest first, three or more) that gives a struct of CLOSED. The
    fit takes the last `hist` observations, the one before it those without the last; fewer are fitted by lines. A fit of
    values with a null among them is null, as is that of an array that is null."""

    @F.arrow_udf(", ".join(f"{c} double" for c in CLOSED))
    def fits(frames: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        n = np.diff(frames.offsets.to_numpy())
        (f, there, _), (x, _, no_x), (y, _, no_y) = (_last(v, hist + 1) for v in (frames, xs, ys))
        out = []
        with np.errstate(all="ignore"):
            for part, count in ((slice(1, None), n), (slice(0, -1), n - 1)):
                own, at = there[:, part], f[:, part]
                solved = _solved(_power_sums((at - at[:, -1:]).astype("float64"), x[:, part], y[:, part], own), (count >= hist) & (degree > 1))
                absent = [no_x[:, part].any(axis=1)] * 3 + [no_y[:, part].any(axis=1)] * 3
                out += [pa.array(v, mask=none | gap) for (v, none), gap in zip(solved, absent)]
        steps = np.sort(np.where(there[:, 1:-1], np.diff(f[:, 1:], axis=1), np.iinfo("int64").max), axis=1)
        usual = np.take_along_axis(steps, ((np.minimum(n, hist) - 1) // 2)[:, None].astype("int64"), axis=1)[:, 0]
        return pa.StructArray.from_arrays([*out, pa.array(np.maximum(usual, 1).astype("float64"))], CLOSED)

    return fits


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), num(0), lambda acc, x: acc + x)


def orthogonal_fit(times: Column, values: dict[str, Column], degree: Column) -> Column:
    """A struct that fit_value and fit_slope read: scale, the recurrence (a, b) and the coefficients of each of values.
    times, values: arrays of doubles of one length, at least one long; degree: 1 or more."""
    scale = F.greatest(F.array_max(F.transform(times, F.abs)), num(1e-300))
    cut = F.least(degree, F.greatest(F.lit(1), F.size(F.array_distinct(times)) - 1))

    def fitted(t: Column) -> Column:
        ones = F.transform(t, lambda _: num(1))
        n = F.size(t).cast("double")
        start = F.struct(
            ones.alias("p"), F.transform(t, lambda _: num(0)).alias("before"), n.alias("norm"), F.array().cast("array<double>").alias("a"), F.array(num(0)).alias("b"),
            *[F.array(_dot(v, ones) / n).alias(f"c_{k}") for k, v in values.items()],
        )

        def step(s: Column, _: Column) -> Column:
            p, norm = s["p"], s["norm"]
            mean = F.when(norm > 0, _dot(F.zip_with(t, p, lambda x, y: x * y), p) / norm).otherwise(num(0))

            def grown(a: Column) -> Column:
                lead = F.zip_with(t, p, lambda x, y: (x - a) * y)
                return bound(F.zip_with(lead, s["before"], lambda x, y: x - F.element_at(s["b"], -1) * y), lambda q: bound(_dot(q, q), lambda m: after(a, q, m)))

            def after(a: Column, q: Column, m: Column) -> Column:
                real = m > n * ZERO
                return F.struct(
                    q.alias("p"), p.alias("before"), F.when(real, m).otherwise(num(0)).alias("norm"), F.concat(s["a"], F.array(a)).alias("a"),
                    F.concat(s["b"], F.array(F.when(norm > 0, m / norm).otherwise(num(0)))).alias("b"),
                    *[F.concat(s[f"c_{k}"], F.array(F.when(real, _dot(v, q) / m).otherwise(num(0)))).alias(f"c_{k}") for k, v in values.items()],
                )

            return bound(mean, grown)

        return F.aggregate(F.sequence(F.lit(1), cut), start, step)

    return bound(scale, lambda u: bound(F.transform(times, lambda x: x / u), lambda t: bound(fitted(t), lambda f: F.struct(
        u.alias("scale"), f["a"].alias("a"), f["b"].alias("b"), *[f[f"c_{k}"].alias(k) for k in values]
    ))))


def _recurred(fit: Column, name: str, at: Column) -> Column:
    """Value and slope (of scaled time) of a fit at scaled time `at`."""
    c = fit[name]
    start = F.struct(num(1).alias("q"), num(0).alias("q0"), num(0).alias("d"), num(0).alias("d0"), c[0].alias("value"), num(0).alias("slope"))

    def step(s: Column, k: Column) -> Column:
        lead, back = at - F.element_at(fit["a"], k), F.element_at(fit["b"], k)
        q, d = lead * s["q"] - back * s["q0"], s["q"] + lead * s["d"] - back * s["d0"]
        add = F.element_at(c, k + 1)
        return F.struct(q.alias("q"), s["q"].alias("q0"), d.alias("d"), s["d"].alias("d0"), (s["value"] + add * q).alias("value"), (s["slope"] + add * d).alias("slope"))

    return F.aggregate(F.sequence(F.lit(1), F.size(fit["a"])), start, step)


def fit_value(fit: Column, name: str, at: Column) -> Column:
    return _recurred(fit, name, at / fit["scale"])["value"]


def fit_slope(fit: Column, name: str, at: Column) -> Column:
    return _recurred(fit, name, at / fit["scale"])["slope"] / fit["scale"]
