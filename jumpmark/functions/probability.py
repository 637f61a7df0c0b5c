"""Tail probabilities of test statistics, as Arrow functions over small result tables (no numeric library beside numpy)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

_TINY, _EPS = 1e-300, 3e-15


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            step = d * c
            h *= step
        if abs(step - 1.0) < _EPS:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_tail(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below s + 1, a continued fraction above."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * _EPS:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1.0 - s
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 1000):
        b += 2.0
        num = -i * (i - s)
        d = num * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + num / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < _EPS:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2.0, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_share(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if d1 > 0 and d2 > 0 else float("nan")


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2.0, x / 2.0) if df > 0 else float("nan")


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _arrow(f, n: int):
    def over(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")

    if n == 1:

        def one(a: pd.Series) -> pd.Series:
            return over(a)

        return F.pandas_udf(one, "double")
    if n == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return over(a, b)

        return F.pandas_udf(two, "double")

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return over(a, b, c)

    return F.pandas_udf(three, "double")


def p_t(t, df):
    """Two-sided probability of Student's t; null in, null out."""
    return _arrow(t_two_sided, 2)(t, df)


def p_f(f, d1, d2):
    return _arrow(f_tail, 3)(f, d1, d2)


def p_chi2(x, df):
    return _arrow(chi2_tail, 2)(x, df)


def p_normal(z):
    return _arrow(normal_two_sided, 1)(z)
