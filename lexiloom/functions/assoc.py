"""Association measures over 2x2 tables given as f12, f1, f2 and n, or as a struct with these fields."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ieee import NAN, col, div, ln
from .validate import check_choice

FIELDS = ("f12", "f1", "f2", "n")
ALTERNATIVES = ("twosided", "greater", "less")


def cells(*args: str | Column) -> list[Column]:
    """The four numbers as doubles, from four columns or a struct; by default the struct ``freqs``."""
    if len(args) == 4:
        return [col(a).cast("double") for a in args]
    if len(args) <= 1:
        s = col(args[0]) if args else F.col("freqs")
        return [s.getField(f).cast("double") for f in FIELDS]
    raise TypeError("pass a struct, or f12, f1, f2 and n")


def freqs(f12, f1, f2, n) -> Column:
    """The struct that all measures read."""
    return F.struct(*[col(v).cast("bigint").alias(k) for k, v in zip(FIELDS, (f12, f1, f2, n))])


def pmi(*args) -> Column:
    """ln(f12 n / (f1 f2))."""
    f12, f1, f2, n = cells(*args)
    return ln(div(f12 * n, f1 * f2))


def chisq(*args, yates: bool = False) -> Column:
    """Pearson's chi-squared; with ``yates`` its continuity correction, not clamped."""
    f12, f1, f2, n = cells(*args)
    o12, o21 = f1 - f12, f2 - f12
    det = f12 * (n - f1 - f2 + f12) - o12 * o21
    if yates:
        det = F.abs(det) - n / F.lit(2.0)
    return div(n * det * det, f1 * f2 * (n - f1) * (n - f2))


def loglik(*args) -> Column:
    """Dunning's G2, negative where the pair is rarer than expected."""
    f12, f1, f2, n = cells(*args)

    def part(o: Column, e: Column) -> Column:
        return F.when(o == 0, F.lit(0.0)).when((o < 0) | (e <= 0), F.lit(NAN)).otherwise(o * F.log(F.try_divide(o, e)))

    o = [f12, f1 - f12, f2 - f12, n - f1 - f2 + f12]
    e = [F.try_divide(a * b, n) for a, b in ((f1, f2), (f1, n - f2), (n - f1, f2), (n - f1, n - f2))]
    g = F.lit(2.0) * (part(o[0], e[0]) + part(o[1], e[1]) + part(o[2], e[2]) + part(o[3], e[3]))
    total = f12 + f1 + f2 + n  # null, NaN or infinite if one of them is
    bad = total.isNull() | F.isnan(total) | (F.abs(total) == F.lit(float("inf"))) | (f12 < 0) | (f1 <= 0) | (f2 <= 0) | (n <= 0)
    return F.when(bad, F.lit(None).cast("double")).when(o[0] < e[0], -g).otherwise(g)


def minsens(*args) -> Column:
    """Minimum sensitivity: the lesser of f12/f1 and f12/f2."""
    f12, f1, f2, _ = cells(*args)
    a, b = div(f12, f1), div(f12, f2)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.least(a, b))


def smp(*args, k: float) -> Column:
    """Simple maths on raw counts: (f12 + k) / (f1 - f12 + k)."""
    f12, f1, _, _ = cells(*args)
    return div(f12 + F.lit(float(k)), f1 - f12 + F.lit(float(k)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), for all rows at once until each has settled."""
    tiny = 1e-300
    big = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1.0 / big(1.0 - (a + b) * x / (a + 1))
    h = d.copy()
    left = np.arange(len(x))
    for m in range(1, 500):
        p, q, y = a[left], b[left], x[left]
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d[left] = 1.0 / big(1.0 + num * d[left])
            c[left] = big(1.0 + num / c[left])
            h[left] *= d[left] * c[left]
        left = left[np.abs(d[left] * c[left] - 1.0) >= 1e-16]
        if not len(left):
            break
    return h


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    out = (x >= 1).astype(float)
    some = np.flatnonzero((x > 0) & (x < 1))
    a, b, x = a[some], b[some], x[some]
    gamma = lambda v: np.fromiter(map(math.lgamma, v), float, len(v))
    front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    got = np.empty_like(x)
    got[low] = front[low] * _beta_fraction(a[low], b[low], x[low]) / a[low]
    got[~low] = 1.0 - front[~low] * _beta_fraction(b[~low], a[~low], 1.0 - x[~low]) / b[~low]
    out[some] = got
    return out


def student_sf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t)."""
    half = 0.5 * beta_inc(df / 2, np.full(len(t), 0.5), df / (df + t * t))
    return np.where(t >= 0, half, 1.0 - half)


@F.pandas_udf(T.DoubleType())
def _p_value(t: pd.Series, df: pd.Series, alt: pd.Series) -> pd.Series:
    x, d = t.to_numpy(float), df.to_numpy(float)
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(~np.isnan(x) & ~np.isnan(d))
    if len(ok):
        kind = alt.iloc[0]  # one for the whole column
        x, d = x[ok], d[ok]
        out[ok] = student_sf(x, d) if kind == "greater" else student_sf(-x, d) if kind == "less" else np.minimum(1.0, 2 * student_sf(np.abs(x), d))
    return pd.Series(out).astype("Float64").where(~np.isnan(out), None)


def welchs_t_from_stats(s1, ss1, n1, s2, ss2, n2, alt: str = "twosided", p: bool = True) -> Column:
    """Struct {t, p, df, g} from sums, sums of squares and sizes; null fields if a size is under 2 or nothing varies.
    Without ``p`` the plan has no Python."""
    alt = check_choice(alt, ALTERNATIVES, "alt")
    s1, ss1, n1, s2, ss2, n2 = (col(x).cast("double") for x in (s1, ss1, n1, s2, ss2, n2))
    null = F.lit(None).cast("double")

    def var(s, ss, n):
        return F.when(n >= 2, (ss - s * s / F.when(n > 0, n)) / F.when(n > 1, n - 1))

    v1, v2 = var(s1, ss1, n1), var(s2, ss2, n2)
    a, b = v1 / F.when(n1 > 0, n1), v2 / F.when(n2 > 0, n2)
    ok = (a + b) > 0
    t = F.when(ok, (s1 / F.when(n1 > 0, n1) - s2 / F.when(n2 > 0, n2)) / F.sqrt(F.when(ok, a + b)))
    below = a * a / F.when(n1 > 1, n1 - 1) + b * b / F.when(n2 > 1, n2 - 1)
    df = F.when(ok, (a + b) * (a + b) / F.when(below > 0, below))
    g = F.when(ok, t * F.sqrt(F.lit(2.0) * (a + b) / F.when((v1 + v2) > 0, v1 + v2)) * (F.lit(1.0) - F.lit(3.0) / (F.lit(4.0) * df - 1)))
    return F.struct(t.alias("t"), (_p_value(t, df, F.lit(alt)) if p else null).alias("p"), df.alias("df"), g.alias("g"))


def welchs_t(x1, x2, alt: str = "twosided", p: bool = True) -> Column:
    """welchs_t_from_stats() as an aggregate over two columns, whose nulls don't count."""
    stats = [f(col(x).cast("double")) for x in (x1, x2) for f in (lambda c: F.coalesce(F.sum(c), F.lit(0.0)), lambda c: F.coalesce(F.sum(c * c), F.lit(0.0)), F.count)]
    return welchs_t_from_stats(*stats, alt=alt, p=p)
