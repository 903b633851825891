"""Quantiles of Beta distributions, vectorised in NumPy and as a column function."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_log_gamma = np.vectorize(math.lgamma, otypes=[float])
_TINY = 1e-300


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz method; x below (a + 1) / (a + b + 2)."""
    away = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + term * d), away(1 + term / c)
            out *= c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            return out
    return out


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b)."""
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    swap = y > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - y, y)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + p * np.log(z) + q * np.log1p(-z)) / p
    low = front * _fraction(p, q, z)
    return np.where(inside, np.where(swap, 1 - low, low), (x >= 1).astype(float))


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with I_x(a, b) = p, by Newton steps kept inside a bracket that every step narrows."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    low, high, x = np.zeros_like(a), np.ones_like(a), a / (a + b)
    scale = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
    for _ in range(200):
        gap = beta_cdf(a, b, x) - p
        low, high = np.where(gap < 0, x, low), np.where(gap < 0, high, x)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            step = x - gap / np.exp(scale + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.all(np.abs(new - x) <= 1e-15 * x + _TINY):
            return new
        x = new
    return x


def beta_quantiles(p: float, a: Column, b: Column) -> Column:
    """The quantile p of Beta(a, b); null unless both parameters are positive."""

    @F.arrow_udf(DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.asarray(c.to_numpy(zero_copy_only=False), float) for c in (a, b))
        ok = (x > 0) & (y > 0) & np.isfinite(x) & np.isfinite(y)
        out = np.full(len(x), np.nan)
        out[ok] = beta_quantile(p, x[ok], y[ok])
        return pa.array(out, mask=~ok)

    return run(a.cast("double"), b.cast("double"))
