"""Numeric column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, the engine's only missing value."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def div(a: Column, b: Column, floor: float | None = None) -> Column:
    """a / b, NULL when b is zero (or not above ``floor``)."""
    ok = b != 0 if floor is None else b > floor
    return F.when(ok, a / F.when(ok, b))


def trapezoid(prev_x: Column, prev_y: Column, x: Column, y: Column) -> Column:
    """Area of one trapezoid between consecutive samples."""
    return (x - prev_x) * (y + prev_y) / 2


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson r from sums; NULL when n < 2 or a population deviation is <= 1e-12."""
    vx, vy = sxx / n - (sx / n) * (sx / n), syy / n - (sy / n) * (sy / n)
    ok = (n >= 2) & (vx > EPS * EPS) & (vy > EPS * EPS)
    return F.when(ok, (sxy / n - (sx / n) * (sy / n)) / F.when(ok, F.sqrt(vx) * F.sqrt(vy)))


def corr_guarded(x: Column, y: Column) -> Column:
    """Aggregate Pearson r that yields NULL on constant input instead of raising."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    ok = (F.count(F.lit(1)) >= 2) & (sx > EPS) & (sy > EPS)
    return F.when(ok, F.covar_pop(x, y) / F.when(ok, sx * sy))


def null_safe_delta(a: Column, b: Column) -> Column:
    """a - b with every non-finite side treated as missing."""
    return finite(a) - finite(b)


def magnitude(x: Column, y: Column, z: Column) -> Column:
    """Signal vector magnitude of three axes."""
    return F.sqrt(x * x + y * y + z * z)
