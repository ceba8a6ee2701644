"""Two-sided normal tail probabilities as plain Spark expressions.

Spark has no error function. The upper tail is written as
``exp(-z*z/2) * R(z)`` with the published Hart rational approximation for ``R``
(and its continued fraction beyond the crossover). Because ``R`` stays in
range, ``-log10 p`` can be taken in log space and is finite for every z.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: coefficients of Hart's approximation, highest power first ---
_NUMERATOR = (
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
_DENOMINATOR = (
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
_CROSSOVER = 7.07106781186547
_SQRT_2PI = 2.506628274631
_LOG10_E = 0.4342944819032518


def _horner(z: Column, coefficients) -> Column:
    return reduce(lambda acc, c: acc * z + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def _tail_ratio(z: Column) -> Column:
    fraction = reduce(lambda acc, k: z + F.lit(float(k)) / acc, (4, 3, 2, 1), z + F.lit(0.65))
    return F.when(z < _CROSSOVER, _horner(z, _NUMERATOR) / _horner(z, _DENOMINATOR)).otherwise(
        F.lit(1.0) / (fraction * F.lit(_SQRT_2PI))
    )


def z_score(beta: Column, se: Column) -> Column:
    """BETA / SE; null where SE is zero."""
    return F.try_divide(beta.cast("double"), se.cast("double"))


def norm_p_two_sided(z: Column) -> Column:
    """P(|Z| > |z|) for a standard normal Z."""
    a = F.abs(z)
    return F.lit(2.0) * F.exp(-a * a / 2) * _tail_ratio(a)


def mlog10p_from_z(z: Column) -> Column:
    """-log10 of the two-sided p-value, finite for every z."""
    a = F.abs(z)
    value = a * a * F.lit(0.5 * _LOG10_E) - F.log10(F.lit(2.0) * _tail_ratio(a))
    return F.greatest(value, F.lit(0.0))
