"""Tail probabilities as Column expressions, plus the Student-t tail for result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Rational approximation of the normal upper tail (Hart 1968, West 2005).
TAIL_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
TAIL_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
TAIL_SWITCH = 7.07


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_tail(x: Column) -> Column:
    """P(Z > x) for x >= 0."""
    near = F.exp(-x * x / 2) * _polynomial(x, TAIL_NUMERATOR) / _polynomial(x, TAIL_DENOMINATOR)
    far = F.exp(-x * x / 2) / (x * math.sqrt(2 * math.pi)) * (1 - 1 / (x * x))
    return F.when(x < TAIL_SWITCH, near).when(x >= TAIL_SWITCH, far)


def normal_cdf(z: Column) -> Column:
    tail = normal_tail(F.abs(z))
    return F.when(z < 0, tail).otherwise(1 - tail)


def two_sided_p(z: Column) -> Column:
    """2 P(Z > |z|); computed from the tail, so far tails keep their digits."""
    return 2 * normal_tail(F.abs(z))


SERIES_DF = 20_000


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X > x) of a chi-square with a whole number ``df`` of degrees of freedom.

    Sums exp(-x/2) x^k / k!! terms, which are finite for whole df; each is taken from its logarithm, so
    none over- or underflows. Beyond ``SERIES_DF``, the cube-root normal law (error below 1e-6 there).
    Only meant for result rows.
    """
    odd = df % 2 == 1
    shift = F.when(odd, 1).otherwise(0)
    count = F.floor(df / 2).cast("int")
    safe = F.greatest(x, F.lit(1e-300))
    log_x = F.ln(safe)
    start = F.when(odd, log_x / 2 + math.log(math.sqrt(2 / math.pi))).otherwise(0.0) - safe / 2
    # Each term's logarithm follows from the one before by the next odd (or even) number.
    series = F.aggregate(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        F.struct(F.lit(0.0).alias("total"), start.alias("term")),
        lambda s, k: F.struct(
            (s["total"] + F.exp(s["term"])).alias("total"), (s["term"] + log_x - F.ln(2 * k + shift)).alias("term")
        ),
        lambda s: s["total"],
    )
    exact = F.when(odd, two_sided_p(F.sqrt(x)) + F.when(count > 0, series).otherwise(0.0)).otherwise(series)
    spread = 2 / (9 * df.cast("double"))
    cube = (F.pow(x / df, 1 / 3) - (1 - spread)) / F.sqrt(spread)
    tail = F.when(df <= SERIES_DF, F.least(exact, F.lit(1.0))).otherwise(1 - normal_cdf(cube))
    return F.when((df >= 1) & (x == 0), 1.0).when((df >= 1) & (x > 0), tail)


def kolmogorov_tail(x: Column, terms: int = 100) -> Column:
    """Limit law of sqrt(n) D: 2 sum (-1)^(k-1) exp(-2 k^2 x^2)."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    # The series does not settle near 0, where the tail is 1 to all digits.
    return F.when(x < 0.2, 1.0).when(x >= 0.2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 10_000) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), vectorised; NaN where it does not settle."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    settled = np.zeros(x.shape, bool)
    for m in range(1, steps):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = np.where(settled, h, h * d * c)
        settled |= np.abs(d * c - 1) < 1e-15
        if settled.all():
            break
    return np.where(settled, h, np.nan)


def _log_half_beta(a: np.ndarray) -> np.ndarray:
    """log B(a, 1/2); for large ``a`` from the asymptotic difference of the two log-gammas."""
    exact = np.array([math.lgamma(v) + math.lgamma(0.5) - math.lgamma(v + 0.5) for v in np.minimum(a, 1e6)])
    far = 0.5 * math.log(math.pi) - 0.5 * np.log(a) + 1 / (8 * a) - 1 / (192 * a**3)
    return np.where(a < 1e4, exact, far)


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) for real ``df``, as the regularised incomplete beta function; NaN where that does not settle."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    if ok.any():
        tt, nu = t[ok], df[ok]
        a, b, x = nu / 2, np.full(nu.shape, 0.5), nu / (nu + tt * tt)
        y = tt * tt / (nu + tt * tt)
        with np.errstate(divide="ignore"):
            front = np.exp(-a * np.log1p(tt * tt / nu) + b * np.log(y) - _log_half_beta(a))
        # The fraction converges on the side of the mean; take the complement on the other.
        low = x < (a + 1) / (a + b + 2)
        safe_x, safe_y = np.where(low, x, 0.5 * (a + 1) / (a + b + 2)), np.where(low, 0.0, y)
        direct = front * _beta_fraction(a, b, safe_x) / a
        mirrored = 1 - front * _beta_fraction(b, a, safe_y) / b
        out[ok] = np.clip(np.where(low, direct, mirrored), 0, 1)
    return out


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student-t p-value; applied to result rows only, never to raw rows."""
    p = student_two_sided(t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan))
    return pd.Series(p).astype(object).where(~np.isnan(p), None)
