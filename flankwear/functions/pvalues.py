"""Tail probabilities of test statistics, evaluated on one-row results.

Both tails are integrals of a density that falls from the statistic on:

* chi-square: with ``t = a e^u`` and ``a = df / 2`` the density is ``exp(a (u - e^u + 1) + c(a))``, where
  ``c(a) = a ln a - a - ln G(a)``; below the mean the lower tail is summed as a power series instead;
* Student t: with ``t = sqrt(df) tan w`` the density is proportional to ``cos(w)^(df - 1)``.

Panels of a Gauss-Legendre rule are added until a panel no longer changes the sum; a sum that does not
settle raises an error instead of returning a value.  Normalising constants use Stirling's series for
large degrees of freedom, so no large terms cancel.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)
_PANELS = 200_000
_LARGE = 1e4


def _falling_tail(log_density: Callable[[np.ndarray], np.ndarray], start: float, width: float, end: float = math.inf) -> float:
    """Integral of a falling density from ``start`` to ``end`` in panels of ``width``."""
    total, at = 0.0, start
    for _ in range(_PANELS):
        stop = min(at + width, end)
        half = (stop - at) / 2
        part = half * float(_WEIGHTS @ np.exp(log_density(at + half * (_NODES + 1))))
        total += part
        at = stop
        if at >= end or part <= 1e-17 * total:
            return total
    raise ArithmeticError("the tail integral does not settle")


def _stirling_rest(a: float) -> float:
    """ln G(a) less (a - 1/2) ln a - a + ln(2 pi) / 2."""
    if a > _LARGE:
        return 1 / (12 * a) - 1 / (360 * a ** 3)
    return math.lgamma(a) - ((a - 0.5) * math.log(a) - a + 0.5 * math.log(2 * math.pi))


def _chi2_lower(a: float, x: float) -> float:
    """Lower tail for x < a: x^a e^-x / G(a + 1) times the sum of x^n / ((a + 1) ... (a + n))."""
    r = (x - a) / a
    log_first = a * (math.log1p(r) - r) - 0.5 * math.log(2 * math.pi * a) - _stirling_rest(a)
    total, term, n = 1.0, 1.0, 0
    for _ in range(_PANELS):
        terms = term * np.cumprod(x / (a + np.arange(n + 1, n + 513)))
        total, term, n = total + float(terms.sum()), float(terms[-1]), n + 512
        if term <= 1e-17 * total:
            return math.exp(log_first + math.log(total))
    raise ArithmeticError("the series does not settle")


def chi2_sf_value(stat: float, df: float) -> float:
    """P(chi-square with ``df`` degrees of freedom > ``stat``)."""
    if any(v is None or math.isnan(v) for v in (stat, df)) or stat < 0 or df <= 0:
        return float("nan")
    a, x = df / 2.0, stat / 2.0
    if x == 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    if x < a:
        return 1.0 - _chi2_lower(a, x)
    u = math.log(x / a)
    c = 0.5 * math.log(a / (2 * math.pi)) - _stirling_rest(a)
    width = 1 / (math.sqrt(a) + a * math.expm1(u))      # the density falls by about a factor e over this width
    return _falling_tail(lambda v: a * (v - np.expm1(v)) + c, u, 2 * width)


def t_two_sided_value(t: float, df: float) -> float:
    """P(|Student t with ``df`` degrees of freedom| > |t|)."""
    if any(v is None or math.isnan(v) for v in (t, df)) or df <= 0:
        return float("nan")
    if t == 0:
        return 1.0
    if math.isinf(t):
        return 0.0
    if df > _LARGE:      # G((df + 1) / 2) / G(df / 2)
        log_c = 0.5 * math.log(df / 2) + math.log1p(-1 / (4 * df) + 1 / (32 * df * df))
    else:
        log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2)
    log_c += math.log(2) - 0.5 * math.log(math.pi)
    w = math.atan2(abs(t), math.sqrt(df))
    width = 1 / (math.sqrt(df) + df * math.tan(min(w, 1.5)))
    return min(1.0, _falling_tail(lambda v: (df - 1) * np.log(np.cos(v)) + log_c, w, 2 * width, math.pi / 2))


@F.pandas_udf(T.DoubleType())
def _chi2_sf(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf_value(s, d) if pd.notna(s) and pd.notna(d) else np.nan for s, d in zip(stat, df)])


@F.pandas_udf(T.DoubleType())
def _t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_value(a, d) if pd.notna(a) and pd.notna(d) and d > 0 else np.nan
                      for a, d in zip(t, df)])


def chi2_sf(stat: Column, df: Column) -> Column:
    """P(χ²_df > stat)."""
    return _chi2_sf(stat.cast("double"), df.cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value."""
    return _t_sf2(t.cast("double"), df.cast("double"))
