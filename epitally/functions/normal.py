"""The inverse of the normal distribution function as a Column expression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import erfc, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rational approximation AS 241 (PPND16), good to sixteen digits. Each pair holds the
# coefficients of the numerator and of the denominator, from the constant up: near the middle, in the tails, far out.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
MIDDLE_HALF_WIDTH, MIDDLE_SHIFT = 0.425, 0.180625
TAIL_SHIFT, FAR_FROM = 1.6, 5.0


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    return reduce(lambda value, c: value * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def _ratio(x: Column, pair: tuple[Sequence[float], Sequence[float]]) -> Column:
    return _polynomial(x, pair[0]) / _polynomial(x, pair[1])


def normal_quantile(p: Column) -> Column:
    """The value below which a standard normal lies with chance ``p``; infinite at 0 and 1, null outside."""
    q = p - F.lit(0.5)
    middle = q * _ratio(F.lit(MIDDLE_SHIFT) - q * q, MIDDLE)
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    tail = F.when(r <= FAR_FROM, _ratio(r - F.lit(TAIL_SHIFT), TAIL)).otherwise(_ratio(r - F.lit(FAR_FROM), FAR))
    inside = F.when(F.abs(q) <= MIDDLE_HALF_WIDTH, middle).otherwise(F.signum(q) * tail)
    ends = F.when(p == 0.0, F.lit(float("-inf"))).when(p == 1.0, F.lit(float("inf")))
    return F.when((p > 0.0) & (p < 1.0), inside).otherwise(ends)


def upper_tail(z: float) -> float:
    """The chance that a standard normal lies above ``z``."""
    return 0.5 * erfc(z / sqrt(2.0))
