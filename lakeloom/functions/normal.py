"""The normal distribution as column expressions, by published approximations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: Abramowitz and Stegun 26.2.17
CDF_P, CDF_D = 0.2316419, 0.3989423
CDF_B = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)
# fixed values: Abramowitz and Stegun 26.2.23
HASTINGS_C, HASTINGS_D = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
# fixed values: Acklam's rational approximation of the inverse
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.38357751867269e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
# fixed values: Abramowitz and Stegun 7.1.26, the error function
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Coefficients from the highest power down."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + float(c)
    return out


def cdf(x: Column) -> Column:
    """Phi(x), to about 1e-5."""
    t = 1 / (1 + CDF_P * F.abs(x))
    tail = CDF_D * F.exp(-x * x / 2) * t * polynomial(t, CDF_B[::-1])
    return F.when(x > 0, 1 - tail).otherwise(tail)


def inverse(p: Column) -> Column:
    """Phi^-1(p), to about 1e-9, p held within 1e-10 of 0 and 1."""
    p = F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
    edge = lambda q: polynomial(q, ACKLAM_C) / polynomial(q, (*ACKLAM_D, 1.0))
    mid = p - 0.5
    centre = polynomial(mid * mid, ACKLAM_A) * mid / polynomial(mid * mid, (*ACKLAM_B, 1.0))
    return F.when(p < 0.02425, edge(F.sqrt(-2 * F.log(p)))).when(p <= 1 - 0.02425, centre).otherwise(-edge(F.sqrt(-2 * F.log(1 - p))))


def quantile(p: float) -> float:
    """Phi^-1(p) of a number by the Hastings approximation, to about 4e-4."""
    import math

    p = min(max(p, 1e-10), 1 - 1e-10)
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    top = sum(c * t**i for i, c in enumerate(HASTINGS_C))
    bottom = 1 + sum(d * t ** (i + 1) for i, d in enumerate(HASTINGS_D))
    z = t - top / bottom
    return -z if p < 0.5 else z


def option_cdf(x: Column) -> Column:
    """The distribution that option prices use here: the error function's polynomial at x itself,
    with exp(-x^2 / 2).  It is not Phi; it is kept so that prices agree with the surveyed engine."""
    a = F.abs(x)
    t = 1 / (1 + ERF_P * a)
    y = 1 - polynomial(t, ERF_A[::-1]) * t * F.exp(-a * a / 2)
    return 0.5 * (1 + F.when(x < 0, -y).otherwise(y))
