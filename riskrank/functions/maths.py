"""Guarded arithmetic and the tail probabilities Spark has no built-in for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational Chebyshev fit of erfc
# (relative error below 1.2e-7), highest power first.
ERFC_FIT = [
    0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
    -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223,
]


def share(part: Column, whole: Column, default: float = 0.0) -> Column:
    """``part / whole``, or ``default`` where the whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(default))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """Rounded percentage; NULL for an empty whole."""
    return F.round(F.try_divide(part, whole) * 100, digits)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value on either side; NULL stays NULL and NaN, which sorts above all numbers, NaN."""
    number = ~F.isnan(value.cast("double"))
    bounded = value
    if low is not None:
        bounded = F.when(number & (value < low), F.lit(low)).otherwise(bounded)
    if high is not None:
        bounded = F.when(number & (value > high), F.lit(high)).otherwise(bounded)
    return bounded


def finite_or(value: Column, default: float) -> Column:
    """Replace NULL, NaN and infinities."""
    number = value.cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(usable, number).otherwise(F.lit(default))


def erfc(x: Column) -> Column:
    """Complementary error function for ``x >= 0``."""
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.5)
    poly = F.lit(ERFC_FIT[0])
    for coefficient in ERFC_FIT[1:]:
        poly = poly * t + F.lit(coefficient)
    return t * F.exp(poly - x * x)


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the standard normal, capped at 1."""
    return F.least(F.lit(1.0), erfc(F.greatest(z, F.lit(0.0)) / F.sqrt(F.lit(2.0))))


def chi_square_tail(statistic: Column, dof: Column) -> Column:
    """Upper tail of chi-square for integer degrees of freedom (finite series).

    Even ``dof``: exp(-h) * sum h^k/k!, starting at k = 0; odd ``dof``:
    erfc(sqrt h) + exp(-h) * sum h^(k-1/2)/Gamma(k+1/2), with h = statistic/2.
    Each term is the one before it times h/(k + offset).
    """
    half = statistic / 2.0
    odd = (dof % 2) == 1
    terms = F.floor(dof / 2).cast("int")
    offset = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    first = F.when(odd, F.sqrt(half) * 2.0 / F.sqrt(F.lit(3.141592653589793))).otherwise(F.lit(1.0))
    steps = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(
        F.array().cast("array<int>"))
    series = F.aggregate(
        steps,
        F.struct(first.alias("term"), first.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * half / (k + offset)).alias("term"),
            (acc["total"] + acc["term"] * half / (k + offset)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    tail = F.exp(-half) * F.when(terms > 0, series).otherwise(F.lit(0.0))
    return F.when(dof <= 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), tail + F.when(odd, erfc(F.sqrt(half))).otherwise(F.lit(0.0))))


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
