"""Special functions on NumPy arrays, and the Arrow functions built on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_gamma(x) -> np.ndarray:
    """For positive x: products up to 10, then Stirling's series."""
    x = np.asarray(x, float)
    up = np.where(x < 10, x + 10, x)
    y = 1 / (up * up)
    series = (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / up
    small = np.where(x < 10, x, 1.0)
    product = small.copy()
    for k in range(1, 10):
        product = product * (small + k)
    return np.where(x < 10, series - np.log(product), series)


def digamma(x) -> np.ndarray:
    """For positive x: recurrence up to 10, then the asymptotic series."""
    x, out = np.array(x, float), 0.0
    while np.any(x < 10):
        small = x < 10
        out = out - np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x) -> np.ndarray:
    x, out = np.array(x, float), 0.0
    while np.any(x < 10):
        small = x < 10
        out = out + np.where(small, 1 / (x * x), 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def gamma_cdf(x, shape, scale=1.0) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series below shape + 1, above it a continued fraction."""
    x, a = np.broadcast_arrays(np.asarray(x, float) / np.asarray(scale, float), np.asarray(shape, float))
    out = np.where(x > 0, np.nan, 0.0)
    out = np.where(np.isposinf(x), 1.0, out)
    low = (x > 0) & (x < a + 1)
    high = (x >= a + 1) & np.isfinite(x)
    if low.any():
        out[low] = _lower_series(x[low], a[low])
    if high.any():
        out[high] = 1 - _upper_fraction(x[high], a[high])
    return out


#: Values that have settled are taken out after this many terms, so that one slow value doesn't hold up all others.
_TERMS = 8


def _lower_series(u: np.ndarray, s: np.ndarray) -> np.ndarray:
    front, out, left = np.exp(-u + s * np.log(u) - log_gamma(s)), 1 / s, np.arange(u.size)
    term, total = out.copy(), out.copy()
    for k in range(1, 2000):
        term = term * u / (s + k)
        total = total + term
        if k % _TERMS == 0:
            out[left] = total
            more = term >= total * 1e-16
            if not more.any():
                break
            left, u, s, term, total = left[more], u[more], s[more], term[more], total[more]
    else:
        out[left] = total
    return out * front


def _upper_fraction(u: np.ndarray, s: np.ndarray) -> np.ndarray:
    front, left = np.exp(-u + s * np.log(u) - log_gamma(s)), np.arange(u.size)
    b = u + 1 - s
    f, big, d = 1 / b, np.full_like(b, 1e300), 1 / b
    out = f.copy()
    for k in range(1, 2000):
        an = -k * (k - s)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        big = b + an / big
        big = np.where(np.abs(big) < 1e-300, 1e-300, big)
        step = d * big
        f = f * step
        if k % _TERMS == 0:
            out[left] = f
            more = np.abs(step - 1) >= 1e-15
            if not more.any():
                break
            left, s, b, f, big, d = left[more], s[more], b[more], f[more], big[more], d[more]
    else:
        out[left] = f
    return out * front


def gamma_quantile(p, shape, scale=1.0) -> np.ndarray:
    """The inverse of gamma_cdf: Halley's steps on log x, kept between bounds that close in."""
    p, a = np.broadcast_arrays(np.asarray(p, float), np.asarray(shape, float))
    q = np.clip(p, 1e-300, 1 - 1e-16)
    z = np.sqrt(2) * _erf_inverse(2 * q - 1)
    cube = 1 - 1 / (9 * a) + z / (3 * np.sqrt(a))
    start = np.where(cube > 0.1, a * np.maximum(cube, 0.1) ** 3, np.exp((np.log(q) + log_gamma(a + 1)) / a))
    y = np.log(np.clip(start, 1e-300, 1e300))
    shape_of, y, q = a.shape, y.ravel(), q.ravel()
    out, left, logs = y.copy(), np.arange(y.size), log_gamma(a).ravel()
    flat, low, high = a.ravel(), np.full_like(y, -690.0), np.full_like(y, 690.0)
    for _ in range(200):  # of the values that still move
        x, s = np.exp(y), flat[left]
        gap = gamma_cdf(x, s) - q[left]
        slope = np.exp(np.clip(s * y - x - logs[left], -700, 700))
        step = np.clip(gap / np.maximum(slope, 1e-300), -1400, 1400)
        step = step / np.clip(1 - step * (s - x) / 2, 0.5, 2)
        # Halley's step cubes the error, times the shape: after so small a one nothing is left of it. Looked at before the bounds, which such a y has reached.
        there = np.abs(step) < 1e-5 / np.sqrt(1 + s)
        low, high = np.where(gap < 0, np.maximum(low, y), low), np.where(gap >= 0, np.minimum(high, y), high)
        new = y - step
        new = np.where(there | ((new > low) & (new < high)), new, (low + high) / 2)
        out[left] = new
        moves = ~there & (np.abs(new - y) >= 1e-14 * np.maximum(1, np.abs(y)))
        if not moves.any():
            break
        left, y, low, high = left[moves], new[moves], low[moves], high[moves]
    y = out.reshape(shape_of)
    return np.where(p <= 0, 0.0, np.where(p >= 1, np.inf, np.exp(y))) * scale


def _erf_inverse(x: np.ndarray) -> np.ndarray:
    """A start for gamma_quantile, good to 2e-3."""
    ln = np.log(np.maximum(1 - x * x, 1e-300))
    k = 2 / (math.pi * 0.147) + ln / 2
    return np.sign(x) * np.sqrt(np.sqrt(k * k - ln / 0.147) - k)


def kolmogorov_tail(d: float, n: int) -> float:
    """P(D_n >= d) of the two-sided one-sample statistic: a matrix power up to 2,000 samples, then the limiting series."""
    if not 0 < d < 1 or n <= 0:
        return 1.0 if d <= 0 else 0.0
    s = d * d * n
    if s > 18:
        return 0.0
    if n > 2000:
        return float(np.clip(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * s) for k in range(1, 101)), 0, 1))
    k = math.floor(n * d) + 1
    h, m = k - n * d, 2 * k - 1
    matrix = np.tri(m, m, 1)
    powers = h ** np.arange(1, m + 1)
    matrix[:, 0] -= powers
    matrix[-1] -= powers[::-1]
    matrix[-1, 0] += max(0.0, 2 * h - 1) ** m
    gap = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    matrix = np.where(gap > 0, matrix * np.exp(-log_gamma(np.maximum(gap, 0) + 1)), matrix)
    result, exponent, base, shift, left = np.eye(m), 0, matrix, 0, n
    while left:
        if left & 1:
            result, exponent = result @ base, exponent + shift
        base, shift, left = base @ base, 2 * shift, left >> 1
        for name in ("base", "result"):
            value = base if name == "base" else result
            if abs(value[k - 1, k - 1]) > 1e140:
                if name == "base":
                    base, shift = base * 1e-140, shift + 140
                else:
                    result, exponent = result * 1e-140, exponent + 140
    value = result[k - 1, k - 1]
    log = math.log(max(value, 1e-320)) + exponent * math.log(10) + math.lgamma(n + 1) - n * math.log(n)
    return float(np.clip(1 - math.exp(min(log, 0.0)), 0, 1))


@F.pandas_udf(T.DoubleType())
def _ks_pvalue(stat: pd.Series, n: pd.Series) -> pd.Series:
    pairs = [(None, 0) if pd.isna(d) else (float(d), round(k / 2)) for d, k in zip(stat, n, strict=True)]
    known = {x: None if x[0] is None else kolmogorov_tail(*x) for x in set(pairs)}
    return pd.Series([known[x] for x in pairs], dtype="float64")


def ks_pvalue(stat: Column, n: Column) -> Column:
    """The p-value of the two-sample statistic of two samples of n: that of one sample of n / 2."""
    return _ks_pvalue(stat, n)
