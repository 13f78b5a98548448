"""Tails of Student's t and the normal distribution, and text similarity, as small vectorised helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _continued(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return float("nan")
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; null without one."""

    @F.pandas_udf("double")
    def p(ts, dfs):
        return ts.combine(dfs, lambda t, df: None if math.isnan(df) else t_two_sided(t, df))

    known = t.isNotNull() & df.isNotNull()
    return F.when(known, p(F.when(known, t.cast("double")), F.when(known, df.cast("double"))))


def normal_p_value(z: Column) -> Column:
    """Two-sided p-value of a normal statistic."""

    @F.pandas_udf("double")
    def p(zs):
        return zs.map(normal_two_sided, na_action="ignore")

    return p(z.cast("double"))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & places.get(c, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def similarity(a: Column, b: Column) -> Column:
    """Indel similarity of two texts: 100 * 2 * LCS / (len1 + len2), rounded; 0 for nulls."""

    @F.pandas_udf("int")
    def ratio(xs, ys):
        return xs.fillna("").combine(ys.fillna(""), lambda x, y: round(200 * common_subsequence(x, y) / (len(x) + len(y))) if x and y else 0).astype("int32")

    return ratio(a, b)
