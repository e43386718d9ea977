"""Distribution functions over result-sized columns: incomplete beta and what follows from it.

Spark has no t or F distribution, so these are Arrow-batched pandas UDFs.  They
run on one row per fitted series or test, never on fact rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _lgamma(x):
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def betainc(a, b, x):
    """Regularised incomplete beta by its continued fraction, elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    safe = np.clip(z, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(safe) + q * np.log1p(-safe)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for numerator in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    lower = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(flip, 1 - lower, lower)


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    t1, d1 = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    return np.where(ok, betainc(d1 / 2, 0.5, d1 / (d1 + t1 * t1)), np.where(np.isinf(t), 0.0, np.nan))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    ok = np.isfinite(f) & (f >= 0) & (d1 > 0) & (d2 > 0)
    ff, n1, n2 = np.where(ok, f, 0.0), np.where(ok, d1, 1.0), np.where(ok, d2, 1.0)
    return np.where(ok, betainc(n2 / 2, n1 / 2, n2 / (n2 + n1 * ff)), np.nan)


def t_quantile(p, df):
    """Quantile of Student's t by bisection on the distribution function."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    target = np.where(p < 0.5, 2 * p, 2 * (1 - p))
    lo, hi = np.zeros_like(target), np.full_like(target, 1e8)
    for _ in range(120):
        mid = (lo + hi) / 2
        above = t_two_sided(mid, df) > target
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(p < 0.5, -1, 1) * (lo + hi) / 2


def normal_quantile(p):
    p = np.asarray(p, float)
    cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), otypes=[float])
    lo, hi = np.full_like(p, -40.0), np.full_like(p, 40.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df))


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f, d1, d2))


@F.pandas_udf(DoubleType())
def t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_quantile(p, df))


@F.pandas_udf(DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    return pd.Series(normal_quantile(p))
