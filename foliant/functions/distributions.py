"""Tail probabilities of test statistics, for results of a row a test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_p_of(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_p_of(x: float, k: float) -> float:
    """The upper tail: 1 - P(k / 2, x / 2), by its series or its continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * out


def t_p_of(t: float, df: float) -> float:
    """Two-sided, by the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        out = d
        for m in range(1, 10_000):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + step * d or 1e-300)
                c = 1 + step / c or 1e-300
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return out

    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) if x > 0 else 0.0
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def _column(one, columns: tuple) -> Column:
    def run(*s: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else one(*row) for row in zip(*s)], dtype="float64")

    if len(columns) == 1:

        @F.pandas_udf("double")
        def single(a: pd.Series) -> pd.Series:
            return run(a)

        return single(*columns)

    @F.pandas_udf("double")
    def pair(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return pair(*columns)


def normal_p(z: Column) -> Column:
    return _column(normal_p_of, (z.cast("double"),))


def chi2_p(x: Column, k: Column) -> Column:
    return _column(chi2_p_of, (x.cast("double"), k.cast("double")))


def t_p(t: Column, df: Column) -> Column:
    return _column(t_p_of, (t.cast("double"), df.cast("double")))


def hurwitz_zeta(s: Column, q: Column, scale: Column, terms: int = 12) -> Column:
    """The sum of ((q + n) / scale) ** -s over n >= 0, by Euler and Maclaurin; the scale keeps large powers in range."""
    power = lambda x: (x / scale) ** (-s)
    x = q + terms
    head = sum((power(q + n) for n in range(1, terms)), power(q))
    return head + power(x) * (x / (s - 1) + 0.5 + s / (12 * x) - s * (s + 1) * (s + 2) / (720 * x**3))
