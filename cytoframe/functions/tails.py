"""Distribution tails Spark SQL has no built-in for, as Arrow UDFs over result-sized tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_tail(a, b, x):
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    z = np.clip(z, 1e-300, 1 - 1e-16)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    out = np.where(flip, 1 - front * h, front * h)
    return np.clip(np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out)), 0.0, 1.0)


def t_two_sided(t, df):
    """P(|T| >= |t|); infinite degrees of freedom fall back to the normal law."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    finite = np.where(np.isfinite(df), df, 1.0)
    return np.where(
        np.isfinite(df), beta_tail(finite / 2, 0.5, finite / (finite + t * t)), _erfc(np.abs(t) / math.sqrt(2))
    )


def gamma_upper(a, x):
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    z = np.maximum(x, 1e-300)
    front = np.exp(-z + a * np.log(z) - _lgamma(a))
    term = total = 1 / a
    for n in range(1, 2000):
        term = term * np.where(z < a + 1, z, 0.0) / (a + n)
        total = total + term
        if not (term > 1e-17 * total).any():
            break
    tiny = 1e-300
    b = np.where(z < a + 1, a + 2, z) + 1 - a
    c, d = np.full_like(b, 1 / tiny), 1 / b
    h = d.copy()
    for n in range(1, 2000):
        step = n * (a - n)
        b = b + 2
        d = step * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + step / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if not (np.abs(d * c - 1) > 1e-15).any():
            break
    out = np.where(z < a + 1, 1 - front * total, front * h)
    return np.clip(np.where(x <= 0, 1.0, out), 0.0, 1.0)


def chisq1_upper(x):
    """Upper tail of chi-square with one degree of freedom."""
    return _erfc(np.sqrt(np.asarray(x, float) / 2))


def f_upper(f, df1, df2):
    """Upper tail of F; infinite second degrees of freedom give the chi-square limit."""
    f, df1, df2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, df1, df2)))
    finite = np.isfinite(df2)
    bounded = np.where(finite, df2, 1.0)
    return np.where(finite, beta_tail(bounded / 2, df1 / 2, bounded / (bounded + df1 * f)), gamma_upper(df1 / 2, df1 * f / 2))


def digamma(x):
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        shift -= 1 / x
        x = x + 1
    r = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))


def trigamma(x):
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        shift += 1 / (x * x)
        x = x + 1
    r = 1 / (x * x)
    return shift + 1 / x + 0.5 * r + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def trigamma_inverse(y):
    """Solve trigamma(x) = y by bisection on log x."""
    y = np.asarray(y, float)
    low, high = np.full(y.shape, math.log(1e-8)), np.full(y.shape, math.log(1e8))
    for _ in range(100):
        mid = (low + high) / 2
        above = trigamma(np.exp(mid)) > y
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return np.exp((low + high) / 2)


def _nullable(values, *inputs):
    missing = np.zeros(len(values), dtype=bool)
    for item in inputs:
        missing |= item.isna().to_numpy()
    return pd.Series(values).mask(missing)


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_two_sided(t.fillna(0), df.fillna(1)), t, df)


@F.pandas_udf(T.DoubleType())
def f_upper_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _nullable(f_upper(f.fillna(0), df1.fillna(1), df2.fillna(1)), f, df1, df2)


@F.pandas_udf(T.DoubleType())
def chisq1_upper_p(x: pd.Series) -> pd.Series:
    return _nullable(chisq1_upper(x.fillna(0)), x)


@F.pandas_udf(T.DoubleType())
def digamma_udf(x: pd.Series) -> pd.Series:
    return _nullable(digamma(x.fillna(1)), x)


@F.pandas_udf(T.DoubleType())
def trigamma_udf(x: pd.Series) -> pd.Series:
    return _nullable(trigamma(x.fillna(1)), x)


@F.pandas_udf(T.DoubleType())
def trigamma_inverse_udf(y: pd.Series) -> pd.Series:
    return _nullable(trigamma_inverse(y.fillna(1)), y)


def hypergeometric_upper(k, size, drawn, universe):
    """P(overlap >= k) when ``drawn`` genes are taken from ``universe`` holding ``size`` marked ones, for whole columns."""
    k, size, drawn, universe = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, np.int64)) for v in (k, size, drawn, universe)))
    if not len(k):
        return np.zeros(0)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, universe.max() + 1)))])

    def ln_choose(n, r):
        return log_factorial[n] - log_factorial[r] - log_factorial[n - r]

    low = np.maximum.reduce([k, drawn - (universe - size), np.zeros_like(k)])
    terms = np.maximum(0, np.minimum(size, drawn) - low + 1)
    row = np.repeat(np.arange(len(k)), terms)
    overlap = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(terms) - terms, terms)
    ln = ln_choose(size[row], overlap) + ln_choose((universe - size)[row], drawn[row] - overlap) - ln_choose(universe[row], drawn[row])
    return np.minimum(1.0, np.bincount(row, np.exp(ln), len(k)))


@F.pandas_udf(T.DoubleType())
def hypergeometric_upper_p(k: pd.Series, size: pd.Series, drawn: pd.Series, universe: pd.Series) -> pd.Series:
    return pd.Series(hypergeometric_upper(k, size, drawn, universe), dtype=float)
