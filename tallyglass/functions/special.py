"""Exact tails of Student's t, F and chi-square, as Arrow-batched functions on numpy arrays.

By the regularised incomplete beta (continued fraction) and gamma (series or continued fraction) functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

STEPS, TINY = 300, 1e-300
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The incomplete beta's continued fraction, by Lentz's method."""
    c, d = np.ones_like(x), 1 / _away(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, STEPS):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / _away(1 + top * d), _away(1 + top / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def _away(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < TINY, TINY, x)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of a, b > 0 and x from 0 to 1."""
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        log = (_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float) + p * np.log(y) + q * np.log1p(-y)
        out = np.where(y <= 0, 0.0, np.exp(log) / p * _fraction(p, q, y))
    return np.where(swap, 1 - out, out)


def gamma_sf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function of a > 0 and x >= 0."""
    front = np.exp(np.where(x > 0, a * np.log(np.maximum(x, TINY)) - x, -np.inf) - _lgamma(a).astype(float))
    term = total = 1 / a
    for n in range(1, STEPS * 3):
        term = term * x / (a + n)
        total = total + term
    b = x + 1 - a
    c, d = np.full_like(x, 1 / TINY), 1 / _away(b)
    h = d.copy()
    for n in range(1, STEPS):
        top, b = -n * (n - a), b + 2
        d, c = 1 / _away(top * d + b), _away(b + top / c)
        h = h * d * c
    return np.where(x < a + 1, 1 - front * np.where(x < a + 1, total, 0), front * np.where(x < a + 1, 0, h))


def _arrays(*parts: pd.Series) -> list[np.ndarray]:
    return [p.to_numpy(dtype=float, na_value=np.nan) for p in parts]


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    x, n = _arrays(t, df)
    ok = np.isfinite(x) & (n > 0)
    a, b = np.where(ok, n, 1.0), np.where(ok, x, 0.0)
    return pd.Series(np.where(ok, beta_inc(a / 2, np.full_like(a, 0.5), a / (a + b * b)), np.where(np.isinf(x), 0.0, np.nan)))


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    x, m, n = _arrays(f, d1, d2)
    ok = np.isfinite(x) & (x >= 0) & (m > 0) & (n > 0)
    a, b, c = np.where(ok, m, 1.0), np.where(ok, n, 1.0), np.where(ok, x, 0.0)
    return pd.Series(np.where(ok, beta_inc(b / 2, a / 2, b / (b + a * c)), np.where(np.isinf(x), 0.0, np.nan)))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    v, n = _arrays(x, df)
    ok = np.isfinite(v) & (v >= 0) & (n > 0)
    return pd.Series(np.where(ok, gamma_sf(np.where(ok, n, 1.0) / 2, np.where(ok, v, 0.0) / 2), np.nan))
