"""Tail probabilities as columns, from the math library bundled with Spark; one inverse as a pandas UDF.

All of these are meant for aggregated rows (one per test), not for raw data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _reflect(cls: str, method: str, *args: Column) -> Column:
    return F.reflect(F.lit(f"org.apache.commons.math3.special.{cls}"), F.lit(method), *args).cast("double")


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided Student t p-value; NULL in, NULL out."""
    t, df = t.cast("double"), df.cast("double")
    ok = t.isNotNull() & df.isNotNull() & (df > 0)
    ratio = F.when(ok, df / (df + t * t)).otherwise(F.lit(1.0))
    half = F.when(ok, df / 2).otherwise(F.lit(1.0))
    return F.when(ok, _reflect("Beta", "regularizedBeta", ratio, half, F.lit(0.5)))


def chi2_1_sf(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    x = x.cast("double")
    return F.when(x.isNotNull(), _reflect("Erf", "erfc", F.sqrt(F.coalesce(x, F.lit(0.0)) / 2)))


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided standard normal p-value."""
    z = z.cast("double")
    return F.when(z.isNotNull(), _reflect("Erf", "erfc", F.abs(F.coalesce(z, F.lit(0.0))) / math.sqrt(2.0)))


def _betainc_half(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, 1/2) by its continued fraction (modified Lentz)."""
    b = 0.5
    swap = x > (a + 1) / (a + b + 2)
    p = np.where(swap, b, a)
    q = np.where(swap, a, b)
    z = np.where(swap, 1 - x, x)
    lg = np.vectorize(math.lgamma)
    front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(np.maximum(z, 1e-300)) + q * np.log1p(-np.minimum(z, 1 - 1e-16))) / p
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        for coef in (even, odd):
            d = 1 + coef * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + coef / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = front * h
    return np.where(swap, 1 - out, out)


def t_quantile(df: Column, prob: float = 0.975) -> Column:
    """Student t quantile for aggregated rows, by bisection on the two-sided tail."""
    tail = 2 * (1 - prob)

    @F.pandas_udf(T.DoubleType())
    def solve(nu: pd.Series) -> pd.Series:
        v = nu.to_numpy(dtype=float)
        ok = np.isfinite(v) & (v > 0)
        w = np.where(ok, v, 1.0)
        lo, hi = np.zeros_like(w), np.full_like(w, 1e4)
        for _ in range(80):
            mid = (lo + hi) / 2
            above = _betainc_half(w / (w + mid * mid), w / 2) > tail
            lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
        return pd.Series(np.where(ok, (lo + hi) / 2, np.nan))

    out = solve(df.cast("double"))
    return F.when(~F.isnan(out), out)
