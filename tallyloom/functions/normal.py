"""The normal distribution as column expressions.

Fixed values: the coefficients of formula 7.1.26 of Abramowitz and Stegun for erf, absolute error below 1.5e-7.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 0.3275911
A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + P * x)
    poly = t * (A[0] + t * (A[1] + t * (A[2] + t * (A[3] + t * A[4]))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z < 0, (1 - erf) / 2).otherwise((1 + erf) / 2)


def cdf_sql(z: str) -> str:
    """The same as SQL."""
    x = f"(abs({z}) / {math.sqrt(2)!r}::DOUBLE)"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {P}::DOUBLE * {x}))"
    poly = f"{t} * ({A[0]}::DOUBLE + {t} * ({A[1]}::DOUBLE + {t} * ({A[2]}::DOUBLE + {t} * ({A[3]}::DOUBLE + {t} * {A[4]}::DOUBLE))))"
    erf = f"(1.0::DOUBLE - {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} < 0 THEN (1 - {erf}) / 2 ELSE (1 + {erf}) / 2 END)"


def pdf(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def quantile(p: float) -> float:
    """On the driver."""
    return NormalDist().inv_cdf(p)


def uniform_pdf(x: Column, low: float, high: float) -> Column:
    return F.when(x.between(low, high), F.lit(1 / (high - low))).otherwise(F.lit(0.0))


def exponential_pdf(x: Column, rate: float = 1.0) -> Column:
    return F.when(x >= 0, rate * F.exp(-rate * x)).otherwise(F.lit(0.0))


def triangular_pdf(x: Column, base: float) -> Column:
    """Right triangle: highest at 0, falling to 0 at base."""
    return F.when(x.between(0, base), 2 / base * (1 - x / base)).otherwise(F.lit(0.0))


def exponential_draw(u: Column, rate: float = 1.0) -> Column:
    return -F.log(1 - u) / rate


def triangular_draw(u: Column, base: float) -> Column:
    return base * (1 - F.sqrt(1 - u))


def uniform_draw(u: Column) -> Column:
    """Mean 0, variance 1."""
    return (2 * u - 1) * math.sqrt(3)


def binomial_pmf(x: Column, n: int, p: float) -> Column:
    """Exact, through a table of log factorials of 0..n."""
    logs = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(n + 1)])
    at = lambda c: F.element_at(logs, (c + 1).cast("int"))
    inside = F.least(F.greatest(x, F.lit(0)), F.lit(n))
    value = F.exp(math.lgamma(n + 1) - at(inside) - at(n - inside) + inside * math.log(p) + (n - inside) * math.log(1 - p))
    return F.when(x.between(0, n), value).otherwise(F.lit(0.0))


def hypergeometric_pmf(x: Column, draws: int, hits: int, size: int) -> Column:
    """Of x hits in so many draws without replacement from a population of `size` with `hits` of them."""
    logs = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(size + 1)])
    at = lambda c: F.element_at(logs, c.cast("int") + 1)
    low, high = max(0, draws + hits - size), min(draws, hits)
    k = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    choose = lambda n, c: math.lgamma(n + 1) - at(c) - at(n - c)
    whole = math.lgamma(size + 1) - math.lgamma(draws + 1) - math.lgamma(size - draws + 1)
    return F.when(x.between(low, high), F.exp(choose(hits, k) + choose(size - hits, draws - k) - whole)).otherwise(F.lit(0.0))


def poisson_pmf(x: Column, mean: float) -> Column:
    """For x up to 20."""
    return F.exp(F.lit(-mean)) * F.pow(F.lit(mean), x) / F.factorial(x.cast("int"))
