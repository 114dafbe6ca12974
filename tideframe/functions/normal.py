"""The normal law as column arithmetic: no Catalyst function has it, and rational approximations stay inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Acklam's rational approximation of the normal quantile, relative error below 1.2e-9.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QUANTILE_SPLIT = 0.02425


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Horner's rule, highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def pdf(x: Column) -> Column:
    """Density of the standard normal law."""
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def cdf(x: Column) -> Column:
    """Distribution function of the standard normal law."""
    z = F.abs(x) / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + z * ERF_P)
    tail = _poly(t, ERF_A[::-1]) * t * F.exp(-z * z)
    return F.when(x >= 0, F.lit(1.0) - tail / 2).otherwise(tail / 2)


def quantile(p: Column) -> Column:
    """Quantile of the standard normal law; null outside (0, 1)."""
    q = p - 0.5
    r = q * q
    middle = _poly(r, QUANTILE_A) * q / (_poly(r, QUANTILE_B) * r + 1.0)
    low = F.sqrt(F.log(p) * -2)
    high = F.sqrt(F.log(F.lit(1.0) - p) * -2)
    tail = lambda t: _poly(t, QUANTILE_C) / (_poly(t, QUANTILE_D) * t + 1.0)
    return F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(p < QUANTILE_SPLIT, tail(low)).when(p > 1 - QUANTILE_SPLIT, -tail(high)).otherwise(middle)


def cdf_sql(x: str) -> str:
    """The same distribution function as SQL text, for twins."""
    z = f"(abs({x})/{math.sqrt(2):.17e})"
    t = f"(1.0/(1.0+{z}*{ERF_P:.17e}))"
    poly = f"{ERF_A[4]:.17e}"
    for c in ERF_A[3::-1]:
        poly = f"({poly}*{t}+({c:.17e}))"
    tail = f"({poly}*{t}*exp(-{z}*{z}))"
    return f"(CASE WHEN {x}>=0 THEN 1.0-{tail}/2 ELSE {tail}/2 END)"


def quantile_sql(p: str) -> str:
    """The same quantile as SQL text, for twins."""

    def poly(x: str, cs: tuple[float, ...]) -> str:
        out = f"({cs[0]:.17e})"
        for c in cs[1:]:
            out = f"({out}*{x}+({c:.17e}))"
        return out

    q = f"(CAST({p} AS DOUBLE)-0.5)"
    r = f"({q}*{q})"
    low, high = f"sqrt(-2*ln(greatest(CAST({p} AS DOUBLE),1e-300)))", f"sqrt(-2*ln(greatest(1.0-CAST({p} AS DOUBLE),1e-300)))"
    tail = lambda t: f"({poly(t, QUANTILE_C)}/({poly(t, QUANTILE_D)}*{t}+1.0))"
    return f"(CASE WHEN ({p})<=0 OR ({p})>=1 THEN NULL WHEN ({p})<{QUANTILE_SPLIT} THEN {tail(low)} WHEN ({p})>{1 - QUANTILE_SPLIT} THEN -{tail(high)} ELSE {poly(r, QUANTILE_A)}*{q}/({poly(r, QUANTILE_B)}*{r}+1.0) END)"
