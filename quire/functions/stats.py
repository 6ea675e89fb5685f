"""Statistics as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _term(o: Column, e: Column) -> Column:
    return F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)


def g2(focus: Column, ref: Column, n_focus: Column, n_ref: Column) -> Column:
    """Dunning's log-likelihood; 0 where a side is empty or an expected count is not positive."""
    total = n_focus + n_ref
    e1, e2 = n_focus * (focus + ref) / total, n_ref * (focus + ref) / total
    value = 2.0 * (_term(focus, e1) + _term(ref, e2))
    return F.when((n_focus <= 0) | (n_ref <= 0) | (e1 <= 0) | (e2 <= 0), 0.0).otherwise(F.greatest(value, F.lit(0.0)))


def log_ratio(focus: Column, ref: Column, n_focus: Column, n_ref: Column, prior: float = 0.5) -> Column:
    return F.log2(((focus + prior) / (n_focus + 1.0)) / ((ref + prior) / (n_ref + 1.0)))


def chi2_tail(x: float, dof: float) -> float:
    """P(X >= x) of the chi-square distribution: the upper incomplete gamma function, by series or continued fraction."""
    a, z = dof / 2, x / 2
    if not z > 0:
        return 1.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - scale * total)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        b += 2
        d = 1 / (i * (a - i) * d + b)
        c = b + i * (a - i) / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return scale * h


def t_tails(t: float, dof: float) -> float:
    """P(|T| >= t) of Student's distribution: the incomplete beta function, by continued fraction."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x in (0.0, 1.0):
        return x

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 10_000):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-16:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def chi2_p(chi: Column, dof: Column) -> Column:
    """p value of a chi-square statistic; null where there is none. For tables of results, not of data."""
    f = F.pandas_udf(lambda x, k: pd.Series([chi2_tail(a, b) if pd.notna(a) and b > 0 else None for a, b in zip(x, k)], dtype="float64"), "double")
    return f(chi.cast("double"), dof.cast("double"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p value of a correlation of n pairs; null where it is not defined."""
    def of(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or not b > 2 else 0.0 if abs(a) >= 1 else t_tails(abs(a) * math.sqrt((b - 2) / (1 - a * a)), b - 2) for a, b in zip(x, k)], dtype="float64")

    return F.pandas_udf(of, "double")(r.cast("double"), n.cast("double"))


def register_sql(spark: SparkSession) -> None:
    """``g2(f, r, nf, nr)`` and ``log_ratio(f, r, nf, nr)`` as SQL functions of the session."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION g2(f DOUBLE, r DOUBLE, nf DOUBLE, nr DOUBLE) RETURNS DOUBLE RETURN
        CASE WHEN nf <= 0 OR nr <= 0 OR f + r <= 0 THEN 0.0 ELSE greatest(0.0, 2.0 * (
            CASE WHEN f > 0 THEN f * ln(f / (nf * (f + r) / (nf + nr))) ELSE 0.0 END + CASE WHEN r > 0 THEN r * ln(r / (nr * (f + r) / (nf + nr))) ELSE 0.0 END)) END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION log_ratio(f DOUBLE, r DOUBLE, nf DOUBLE, nr DOUBLE) RETURNS DOUBLE RETURN
        log2(((f + 0.5) / (nf + 1.0)) / ((r + 0.5) / (nr + 1.0)))""")
