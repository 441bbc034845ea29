"""Tail probabilities of the t, F, chi-square and normal distributions (published series and continued fractions),
as plain functions and as Arrow UDFs over one row per group."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 1000):
        n = -i * (i - a)
        b += 2
        d = 1 / ((n * d + b) or _TINY)
        c = (b + n / c) or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    """NaN statistics (no variation at all) give 1, infinite ones 0."""
    if t != t or df <= 0:
        return 1.0
    return 0.0 if math.isinf(t) else beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if f != f or d1 <= 0 or d2 <= 0:
        return float("nan")
    return 0.0 if math.isinf(f) else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return float("nan") if x != x or df <= 0 else gamma_upper(df / 2, x / 2)


def spearman_p(rho: float, n: float) -> float:
    if rho != rho or n < 3:
        return float("nan")
    return 0.0 if abs(rho) >= 1 else t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


@lru_cache(maxsize=64)
def _u_at_most(n1: int, n2: int, top: int) -> int:
    """Number of arrangements without ties whose U is at most ``top``: coefficients of the Gaussian binomial, built by
    multiplying by 1 - q^(n2 + i) and dividing by 1 - q^i, with whole numbers throughout."""
    c = [1] + [0] * top
    for i in range(1, n1 + 1):
        for u in range(top, n2 + i - 1, -1):
            c[u] -= c[u - n2 - i]
        for u in range(i, top + 1):
            c[u] += c[u - i]
    return sum(c)


def mannwhitney_p(u: float, n1: float, n2: float, ties: float) -> float:
    """Two-sided: exact without ties where the smaller group has at most 8 values, else normal with tie and continuity
    correction."""
    if u != u or n1 < 1 or n2 < 1:
        return float("nan")
    hi = max(u, n1 * n2 - u)
    if ties == 0 and min(n1, n2) <= 8:
        a, b = int(min(n1, n2)), int(max(n1, n2))
        return min(1.0, 2 * _u_at_most(a, b, math.floor(a * b - hi + 1e-9)) / math.comb(a + b, a))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (hi - n1 * n2 / 2 - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2)))


def _values(f, *cols: pd.Series) -> pd.Series:  # type: ignore[no-untyped-def]
    values = [f(*(float("nan") if v is None else float(v) for v in row)) for row in zip(*cols)]
    return pd.Series([None if v != v else v for v in values], dtype="float64")


def _udf(f):  # type: ignore[no-untyped-def]
    """An Arrow UDF of a scalar function; nulls count as NaN and a NaN result is null."""

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return _values(f, a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _values(f, a, b, c)

    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return _values(f, a, b, c, d)

    body = {2: two, 3: three, 4: four}[f.__code__.co_argcount]
    return lambda *cols: F.pandas_udf(body, T.DoubleType())(*cols)


t_p, f_p, chi2_p, spearman_pvalue, mannwhitney_pvalue = map(_udf, (t_two_sided, f_upper, chi2_upper, spearman_p, mannwhitney_p))
