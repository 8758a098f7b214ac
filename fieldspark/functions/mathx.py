"""Arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def power_law(x: str | Column, a: float | Column, b: float | Column) -> Column:
    """``a * x ^ b`` (length-to-mass conversion)."""
    a_ = a if isinstance(a, Column) else F.lit(float(a))
    b_ = b if isinstance(b, Column) else F.lit(float(b))
    return a_ * F.pow(_col(x), b_)


def inv_logit(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def safe_divide(num: str | Column, den: str | Column) -> Column:
    """Division that yields NULL (not an ANSI error) for a zero denominator."""
    return F.try_divide(_col(num), _col(den))


def log10_pos(x: str | Column) -> Column:
    """log10 of positive values; zero, negative or NULL -> NULL."""
    col = _col(x)
    return F.when(col > 0, F.log10(col))


def digamma(x: str | Column) -> Column:
    """Logarithmic derivative of the gamma function, for positive ``x``.

    Shifted up by eight, then the asymptotic series; about 1e-12 exact.
    """
    x_ = _col(x)
    z = x_ + F.lit(8.0)
    w = F.lit(1.0) / (z * z)
    series = F.log(z) - F.lit(0.5) / z - w * (
        F.lit(1 / 12) - w * (F.lit(1 / 120) - w * (F.lit(1 / 252) - w * F.lit(1 / 240))))
    for i in range(8):
        series = series - F.lit(1.0) / (x_ + F.lit(float(i)))
    return series


def trigamma(x: str | Column) -> Column:
    """Derivative of ``digamma``, for positive ``x``."""
    x_ = _col(x)
    z = x_ + F.lit(8.0)
    w = F.lit(1.0) / (z * z)
    series = F.lit(1.0) / z + F.lit(0.5) * w + w / z * (
        F.lit(1 / 6) - w * (F.lit(1 / 30) - w * (F.lit(1 / 42) - w * F.lit(1 / 30))))
    for i in range(8):
        series = series + F.lit(1.0) / ((x_ + F.lit(float(i))) * (x_ + F.lit(float(i))))
    return series
