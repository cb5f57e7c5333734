"""Cubic splines with not-a-knot ends: as expressions over arrays, and in numpy for one line of points at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_second_derivatives(lines: DataFrame, x: str, y: str, start: Column, end: Column, out: str) -> DataFrame:
    """lines with `out`: array of the spline's second derivatives at its points. x and y are columns of arrays, x
    increasing; a line of under four points has null.

    start, end: whether the line begins and ends there, so that the not-a-knot conditions hold; elsewhere the second
    derivative is taken as 0, which is forgotten within some tens of points (each takes away two thirds of the error).
    Three diagonals are solved forward and backward, so the work is that of the points.
    """
    n, none = F.size(x), F.lit(0.0)
    step = lambda k: F.get(x, k + 1) - F.get(x, k)
    slope = lambda k: (F.get(y, k + 1) - F.get(y, k)) / step(k)

    def forward(acc: Column, k: Column) -> Column:
        before, after = step(k - 1), step(k)
        first, last = start & (k == 1), end & (k == n - 2)
        lower = before - F.when(last, after * after / before).otherwise(none)
        upper = after - F.when(first, before * before / after).otherwise(none)
        middle = 2 * (before + after) + F.when(first, before * (before + after) / after).otherwise(none) + F.when(last, after * (before + after) / before).otherwise(none)
        pivot = middle - lower * acc["c"]
        right = 6 * (slope(k) - slope(k - 1)) - lower * acc["r"]
        row = F.struct((upper / pivot).alias("c"), (right / pivot).alias("r"))
        return F.struct(row["c"].alias("c"), row["r"].alias("r"), F.array_append(acc["rows"], row).alias("rows"))

    nothing = F.array().cast("array<struct<c:double,r:double>>")
    rows = F.aggregate(F.sequence(F.lit(1), n - 2), F.struct(none.alias("c"), none.alias("r"), nothing.alias("rows")), forward, lambda acc: F.reverse(acc["rows"]))
    # the rows are a column of their own, so that they are found once
    lines = lines.withColumn("_rows", F.when(n >= 4, rows))
    back = lambda acc, row: F.array_append(acc, row["r"] - row["c"] * F.coalesce(F.try_element_at(acc, F.lit(-1)), none))
    lines = lines.withColumn("_inner", F.reverse(F.aggregate("_rows", F.array().cast("array<double>"), back)))  # of points 1 to n - 2
    at = lambda k: F.get("_inner", k)
    low = F.when(start, ((step(F.lit(0)) + step(F.lit(1))) * at(F.lit(0)) - step(F.lit(0)) * at(F.lit(1))) / step(F.lit(1))).otherwise(none)
    high = F.when(end, ((step(n - 2) + step(n - 3)) * at(n - 3) - step(n - 2) * at(n - 4)) / step(n - 3)).otherwise(none)
    return lines.withColumn(out, F.when(n >= 4, F.concat(F.array(low), F.col("_inner"), F.array(high)))).drop("_rows", "_inner")


def slopes(x: Column, y: Column, m: Column) -> Column:
    """Array of the spline's first derivatives at its points, m being its second derivatives."""
    n = F.size(x)

    def at(k: Column) -> Column:
        i = F.least(k, n - 2)
        h = F.get(x, i + 1) - F.get(x, i)
        slope = (F.get(y, i + 1) - F.get(y, i)) / h
        return F.when(k < n - 1, slope - h * (2 * F.get(m, i) + F.get(m, i + 1)) / 6).otherwise(slope + h * (F.get(m, i) + 2 * F.get(m, i + 1)) / 6)

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def value_at(x: Column, y: Column, m: Column, at: Column) -> Column:
    """The spline's value at a place, m being its second derivatives; outside the points the end pieces go on."""
    i = F.greatest(F.lit(0), F.least(F.size(x) - 2, F.size(F.filter(x, lambda v: v <= at)) - 1))
    h = F.get(x, i + 1) - F.get(x, i)
    a, b = F.get(x, i + 1) - at, at - F.get(x, i)
    curve = (F.get(m, i) * a * a * a + F.get(m, i + 1) * b * b * b) / (6 * h)
    return curve + (F.get(y, i) / h - F.get(m, i) * h / 6) * a + (F.get(y, i + 1) / h - F.get(m, i + 1) * h / 6) * b


def parabola_value(x: Column, y: Column, at: Column) -> Column:
    """The value at a place of the polynomial through one, two or three points (Newton's form)."""
    p = lambda a, k: F.get(a, F.lit(k))
    first = (p(y, 1) - p(y, 0)) / (p(x, 1) - p(x, 0))
    second = ((p(y, 2) - p(y, 1)) / (p(x, 2) - p(x, 1)) - first) / (p(x, 2) - p(x, 0))
    line = p(y, 0) + F.coalesce(first * (at - p(x, 0)), F.lit(0.0))
    return line + F.coalesce(second * (at - p(x, 0)) * (at - p(x, 1)), F.lit(0.0))


def parabola_slopes(x: Column, y: Column) -> Column:
    """Array of the derivatives at one, two or three points of the polynomial through them; NaN for one point."""
    p = lambda a, k: F.get(a, F.lit(k))
    first = (p(y, 1) - p(y, 0)) / (p(x, 1) - p(x, 0))
    second = F.coalesce(((p(y, 2) - p(y, 1)) / (p(x, 2) - p(x, 1)) - first) / (p(x, 2) - p(x, 0)), F.lit(0.0))
    return F.transform(x, lambda at: F.when(F.size(x) < 2, F.lit(float("nan"))).otherwise(first + second * (2 * at - p(x, 0) - p(x, 1))))


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, derivative: bool = False) -> np.ndarray:
    """Value or first derivative at `at` of the interpolating spline through (x, y); x must increase.

    Under four points the polynomial through them is taken, and the derivative of one point is NaN.
    """
    n = len(x)
    if n < 4:
        if n < 2:
            return np.full(len(at), np.nan) if derivative or not n else np.full(len(at), y[0])
        p = np.polyfit(x, y, n - 1)
        return np.polyval(np.polyder(p) if derivative else p, at)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    # second derivatives at the inner points: three diagonals, into whose ends the not-a-knot conditions are put
    lower, middle, upper, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    middle[0] += h[0] * (h[0] + h[1]) / h[1]
    upper[0] -= h[0] ** 2 / h[1]
    middle[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
    lower[-1] -= h[-1] ** 2 / h[-2]
    for k in range(1, n - 2):
        factor = lower[k] / middle[k - 1]
        middle[k] -= factor * upper[k - 1]
        right[k] -= factor * right[k - 1]
    m = np.zeros(n)
    m[n - 2] = right[-1] / middle[-1]
    for k in range(n - 4, -1, -1):
        m[k + 1] = (right[k] - upper[k] * m[k + 2]) / middle[k]
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = x[i + 1] - at, at - x[i]
    if derivative:
        return slope[i] - h[i] * (2 * m[i] + m[i + 1]) / 6 + m[i] * b * (1 - b / (2 * h[i])) + m[i + 1] * b * b / (2 * h[i])
    return (m[i] * a**3 + m[i + 1] * b**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * a + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * b
