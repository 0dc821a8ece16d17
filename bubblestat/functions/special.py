"""Tail probabilities and number text, vectorised with numpy, and their pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Stirling's series for the logarithm of the gamma function, Bernoulli numbers over 2k (2k - 1).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_TINY = 1e-300


def _lgamma(x) -> np.ndarray:
    """The logarithm of the gamma function at 0 and above: eight steps up, then Stirling's series."""
    x = np.asarray(x, float)
    z = x + 8
    with np.errstate(divide="ignore"):
        below = np.log(x) + np.log((x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = sum(c / z ** (2 * k + 1) for k, c in enumerate(_STIRLING))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - below


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    out[x <= 0] = 1.0
    low = (x > 0) & (x < a + 1)
    if low.any():
        s, z = a[low], x[low]
        term = total = 1 / s
        for n in range(1, 500):
            term = term * z / (s + n)
            total = total + term
            if np.all(term < total * 1e-17):
                break
        out[low] = 1 - total * np.exp(-z + s * np.log(z) - _lgamma(s))
    high = (x >= a + 1) & (x > 0)
    if high.any():
        out[high] = np.exp(_log_upper(a[high], x[high]))
    return out


def _log_upper(s: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The logarithm of the regularised upper incomplete gamma function where z is s + 1 or more, by its continued fraction; it stays finite where the function is no double any more."""
    b = z + 1 - s
    c, d = np.full(s.shape, 1 / _TINY), 1 / b
    h = d.copy()
    for n in range(1, 500):
        an = -n * (n - s)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-16):
            break
    return -z + s * np.log(z) - _lgamma(s) + np.log(h)


def chi2_log10_sf(x, df) -> np.ndarray:
    """The decimal logarithm of chi2_sf(), for tails of any size."""
    s, z = np.broadcast_arrays(np.asarray(df, float) / 2, np.asarray(x, float) / 2)
    out = np.zeros(s.shape)
    high = (z >= s + 1) & (z > 0)
    with np.errstate(divide="ignore"):
        out[~high] = np.log10(gamma_q(s[~high], z[~high]))
    out[high] = _log_upper(s[high], z[high]) / math.log(10)
    return out


def chi2_sf(x, df) -> np.ndarray:
    """Without the cancellation of 1 - CDF, so small tails keep their digits."""
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def beta_i(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 500):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    p = beta_i(df / 2, 0.5, df / (df + t * t))
    return np.where(np.isfinite(t), p, 1.0)


def normal_two_sided(z) -> np.ndarray:
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(np.asarray(z, float))


def fisher(a: int, b: int, c: int, d: int) -> float | None:
    """Two-sided: the sum of all tables with these margins that are no likelier. None where a margin is zero."""
    row1, row2, col1, n = a + b, c + d, a + c, a + b + c + d
    if not (row1 and row2 and col1 and b + d):
        return None
    x = np.arange(max(0, col1 - row2), min(row1, col1) + 1)
    logs = -_lgamma(x + 1) - _lgamma(row1 - x + 1) - _lgamma(col1 - x + 1) - _lgamma(row2 - col1 + x + 1)
    own = logs[a - x[0]]
    top = logs.max()
    weights = np.exp(logs - top)
    return float(min(1.0, weights[logs <= own + 1e-9].sum() / weights.sum()))


def number_text(x: float | None) -> str:
    """Scientific with four decimals between 0 and 0.1, else four significant digits; NA if there is none."""
    if x is None or x != x:
        return "NA"
    return f"{x:.4e}" if 0 < abs(x) < 0.1 else f"{x:.4g}"


def log10_text(v: float | None) -> str:
    """number_text() of 10 to the power of v, also where that is no double; NA if there is none."""
    if v is None or v != v:
        return "NA"
    if v > -300:
        return number_text(10.0**v)
    power = math.floor(v)
    text = f"{10 ** (v - power):.4f}"
    return f"{text}e{power:+03d}" if text != "10.0000" else f"1.0000e{power + 1:+03d}"


@F.pandas_udf(DoubleType())
def chi2_log10_p(x: pd.Series, df: pd.Series) -> pd.Series:
    known = (x.notna() & df.notna()).to_numpy()
    out = np.full(len(x), np.nan)
    out[known] = chi2_log10_sf(x[known], df[known])
    return pd.Series(out).where(known, None)


@F.pandas_udf(StringType())
def log10_fmt4(v: pd.Series) -> pd.Series:
    return v.map(log10_text)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    known = (x.notna() & df.notna()).to_numpy()
    out = np.full(len(x), np.nan)
    out[known] = chi2_sf(x[known], df[known])
    return pd.Series(out).where(known, None)


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    known = np.flatnonzero(a.notna() & b.notna() & c.notna() & d.notna())
    out = np.full(len(a), np.nan)
    out[known] = fishers(*(x.to_numpy(float)[known].astype(np.int64) for x in (a, b, c, d)))
    return pd.Series(out).where(~np.isnan(out), None)


def fishers(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """fisher() of many tables: log factorials from one array where it is small enough, all tables of the same margins side by side. NaN where a margin is zero."""
    row1, row2, col1, n = a + b, c + d, a + c, a + b + c + d
    out = np.full(len(a), np.nan)
    sane = np.flatnonzero((row1 > 0) & (row2 > 0) & (col1 > 0) & (b + d > 0))
    top = int(n[sane].max()) if len(sane) else 0
    if top >= cells:
        out[sane] = [fisher(*map(int, t)) for t in zip(a[sane], b[sane], c[sane], d[sane], strict=True)]
        return out
    logs = np.append(0, np.cumsum(np.log(np.arange(1, top + 1))))
    low, high = np.maximum(0, col1 - row2), np.minimum(row1, col1)
    ends = np.cumsum((high - low + 1)[sane])
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(cells, ends[-1] if len(ends) else 0, cells)) + 1, len(sane)))
    for part in np.split(sane, cuts[:-1]) if len(sane) else []:
        size = (high - low + 1)[part]
        begins = np.cumsum(size) - size
        of = np.repeat(part, size)
        x = np.arange(len(of)) - np.repeat(begins, size) + low[of]
        weight = -logs[x] - logs[row1[of] - x] - logs[col1[of] - x] - logs[row2[of] - col1[of] + x]
        own = np.repeat(weight[begins + a[part] - low[part]], size)
        share = np.exp(weight - np.repeat(np.maximum.reduceat(weight, begins), size))
        out[part] = np.minimum(1.0, np.add.reduceat(np.where(weight <= own + 1e-9, share, 0), begins) / np.add.reduceat(share, begins))
    return out


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(StringType())
def fmt4(x: pd.Series) -> pd.Series:
    return x.map(number_text)
