"""Normal distribution function as column expressions; Spark has no ``erf``.

The complementary error function is ``exp(-x^2)`` times a function that is smooth in ``t = 2 / (2 + x)``, and
that function is a Chebyshev series in ``t``. Its coefficients are worked out here, in high precision, from
the continued fraction and the power series of ``erfc``; no table is copied from anywhere.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork.functions.attach import let

TERMS = 30
_DIGITS = 60
_PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494")  # fixed value


def _cosine(x: Decimal) -> Decimal:
    """cos by its power series, for ``0 <= x <= pi``."""
    total = term = Decimal(1)
    k = 0
    while abs(term) > Decimal(10) ** -(_DIGITS - 5):
        k += 2
        term *= -x * x / (k * (k - 1))
        total += term
    return total


def _scaled_erfc(x: Decimal) -> Decimal:
    """``exp(x^2) erfc(x)`` for ``x >= 0``."""
    if x < 3:  # erf by a series of positive terms, which loses no digits
        total = term = x
        k = 0
        while term > total * Decimal(10) ** -(_DIGITS - 5):
            k += 1
            term *= 2 * x * x / (2 * k + 1)
            total += term
        return (x * x).exp() - 2 * total / _PI.sqrt()
    fraction = x  # x + (1/2)/(x + (2/2)/(x + (3/2)/(x + ...)))
    for k in range(600, 0, -1):
        fraction = x + Decimal(k) / 2 / fraction
    return 1 / (fraction * _PI.sqrt())


@cache
def coefficients(terms: int = TERMS) -> tuple[float, ...]:
    """Chebyshev coefficients of ``ln(exp(x^2) erfc(x) / t)`` over ``y = 4 t / 2 - 1`` with ``t = 2 / (2 + x)``."""
    with localcontext() as context:
        context.prec = _DIGITS
        n = 2 * terms
        angles = [_PI * (2 * k + 1) / (2 * n) for k in range(n)]
        values = []
        for angle in angles:
            t = (_cosine(angle) + 1) / 2
            values.append((_scaled_erfc(2 / t - 2) / t).ln())
        out = []
        for j in range(terms):
            total = Decimal(0)
            for angle, value in zip(angles, values, strict=True):
                turned = (j * angle) % (2 * _PI)
                total += value * _cosine(min(turned, 2 * _PI - turned))
            out.append(float(total * 2 / n / (2 if j == 0 else 1)))
        return tuple(out)


def erfc(x: Column) -> Column:
    """The complementary error function to 14 digits; NULL for NULL, NaN for NaN."""

    def of(z: Column) -> Column:
        t = 2.0 / (2.0 + z)
        return let(t, lambda u: u * F.exp(_series(4.0 * u / 2.0 - 1.0) - z * z))

    upper = let(F.abs(x), of)
    return F.when(x < 0, 2.0 - upper).otherwise(upper)


def _series(y: Column) -> Column:
    """Clenshaw's sum, as a fold over the coefficients, highest first."""
    high_first = F.array(*[F.lit(c) for c in reversed(coefficients()[1:])])
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def step(acc: Column, c: Column) -> Column:
        return F.struct((2.0 * y * acc["a"] - acc["b"] + c).alias("a"), acc["a"].alias("b"))

    return F.aggregate(high_first, start, step, lambda acc: y * acc["a"] - acc["b"] + coefficients()[0])


def normal_cdf(x: Column) -> Column:
    """Chance that a standard normal value is at most ``x``."""
    return 0.5 * erfc(-x / F.sqrt(F.lit(2.0)))
