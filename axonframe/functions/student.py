"""Student's t: quantiles and p-values from the regularised incomplete beta function."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction, evaluated from the front."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    result = 1.0
    for k in range(0, 400):
        m = k // 2
        if k == 0:
            step = 1.0
        elif k % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or tiny)
        c = (1 + step / c) or tiny
        result *= c * d
        if k and abs(1 - c * d) < 1e-15:
            break
    return front * (result - 1)


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile for p over 0.5, by bisection."""
    lo, hi = 0.0, 1.0
    while t_tail(hi, df) > 2 * (1 - p):
        hi *= 2
    while True:
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            return mid
        lo, hi = (mid, hi) if t_tail(mid, df) > 2 * (1 - p) else (lo, mid)


def t_quantile_table(spark: SparkSession, confidence: float, max_df: int) -> DataFrame:
    """(df, t) for 1 to max_df degrees of freedom; its size is max_df, so it can be broadcast."""
    return spark.createDataFrame([(d, t_quantile((1 + confidence) / 2, d)) for d in range(1, max_df + 1)], "df long, t double")


def t_for_many(confidence: float, df: Column) -> Column:
    """Quantile for 100 and more degrees of freedom from the normal one, by its expansion in 1 / df; good to 1e-8 there."""
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return F.lit(z) + sum(F.lit(c) / F.pow(df.cast("double"), F.lit(float(i + 1))) for i, c in enumerate(terms))


def t_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of many t at once, by the same continued fraction; NaN where t or df is none."""
    out = np.full(len(t), np.nan)
    for k in np.flatnonzero(np.isfinite(df) & (df > 0) & np.isinf(t)):
        out[k] = 0.0
    ok = np.flatnonzero(np.isfinite(t) & np.isfinite(df) & (df > 0))
    x = df[ok] / (df[ok] + t[ok] ** 2)
    a, b = df[ok] / 2, np.full(len(ok), 0.5)
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    inside = (x > 0) & (x < 1)
    safe = np.where(inside, x, 0.5)
    known: dict[float, float] = {}
    gamma = np.array([known.setdefault(d, math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - math.lgamma(0.5)) for d in df[ok].tolist()])
    front = np.exp(gamma + a * np.log(safe) + b * np.log1p(-safe)) / a
    c, d, result = np.ones(len(ok)), np.zeros(len(ok)), np.ones(len(ok))
    for k in range(400):
        m = k // 2
        if k == 0:
            step = np.ones(len(ok))
        elif k % 2 == 0:
            step = m * (b - m) * safe / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * safe / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 + step * d, 1 + step / c
        d, c = 1 / np.where(d == 0, 1e-300, d), np.where(c == 0, 1e-300, c)
        result *= c * d
        if k and (np.abs(1 - c * d) < 1e-15).all():
            break
    value = np.where(inside, front * (result - 1), (x >= 1).astype(float))
    out[ok] = np.where(turned, 1 - value, value)
    return out


#: Lanczos' coefficients for the logarithm of the gamma function (g = 7, nine terms; good to 1e-15).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Steps of the continued fraction at most; it ends by itself where a step changes nothing.
BETA_STEPS = 400


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of 0.5 and more."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + k)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b) for x below its middle, by the continued fraction, evaluated from the front."""
    tiny, one = F.lit(1e-300), F.lit(1.0)

    def step(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        term = F.when(k == 0, one).when(k % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        safe = lambda v: F.when(v == 0, tiny).otherwise(v)
        d, c = one / safe(one + term * acc["d"]), safe(one + term / acc["c"])
        ended = acc["done"] | ((k > 0) & (F.abs(one - c * d) < 1e-15))
        return F.when(acc["done"], acc).otherwise(F.struct(c.alias("c"), d.alias("d"), (acc["v"] * c * d).alias("v"), ended.alias("done")))

    start = F.struct(one.alias("c"), F.lit(0.0).alias("d"), one.alias("v"), F.lit(False).alias("done"))
    value = F.aggregate(F.sequence(F.lit(0), F.lit(BETA_STEPS - 1)), start, step, lambda acc: acc["v"])
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
    return front * (value - 1)


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value, by expressions alone; null where t or df is null or no number, or df is not over 0."""
    t, df = t.cast("double"), df.cast("double")
    x = df / (df + t * t)
    a, half = df / 2, F.lit(0.5)
    below = x <= (a + 1) / (a + 2.5)
    tail = F.when(t == 0, 1.0).when(x <= 0, 0.0).when(below, _fraction(a, half, x)).otherwise(1 - _fraction(half, a, t * t / (df + t * t)))
    usable = t.isNotNull() & df.isNotNull() & ~F.isnan(t) & ~F.isnan(df) & (df > 0)
    return F.when(usable & (F.abs(t) == float("inf")), 0.0).when(usable, tail)
