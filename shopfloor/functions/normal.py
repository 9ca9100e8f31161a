"""Standard normal distribution as column expressions.

Fixed values: the coefficients are those of the published algorithms AS 241
(quantile) and AS 66 (upper tail area), and of Royston's 1995 AS R94 (the
Shapiro-Wilk weights and significance).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTILE_CENTRE_TOP = [
    3.3871328727963666080e0,
    1.3314166789178437745e2,
    1.9715909503065514427e3,
    1.3731693765509461125e4,
    4.5921953931549871457e4,
    6.7265770927008700853e4,
    3.3430575583588128105e4,
    2.5090809287301226727e3,
]
QUANTILE_CENTRE_BOTTOM = [
    1.0,
    4.2313330701600911252e1,
    6.8718700749205790830e2,
    5.3941960214247511077e3,
    2.1213794301586595867e4,
    3.9307895800092710610e4,
    2.8729085735721942674e4,
    5.2264952788528545610e3,
]
QUANTILE_TAIL_TOP = [
    1.42343711074968357734e0,
    4.63033784615654529590e0,
    5.76949722146069140550e0,
    3.64784832476320460504e0,
    1.27045825245236838258e0,
    2.41780725177450611770e-1,
    2.27238449892691845833e-2,
    7.74545014278341407640e-4,
]
QUANTILE_TAIL_BOTTOM = [
    1.0,
    2.05319162663775882187e0,
    1.67638483018380384940e0,
    6.89767334985100004550e-1,
    1.48103976427480074590e-1,
    1.51986665636164571966e-2,
    5.47593808499534494600e-4,
    1.05075007164441684324e-9,
]

# Shapiro-Wilk polynomials, constant term first.
WEIGHT_LAST = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
WEIGHT_NEXT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_MEAN = [0.5440, -0.39978, 0.025054, -0.0006714]
SMALL_LOG_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_SD = [-0.4803, -0.082676, 0.0030302]
SMALL_GAMMA = [-2.273, 0.459]


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution for 1e-11 < p < 1 - 1e-11."""
    q = p - 0.5
    r = 0.180625 - q * q
    centre = q * polynomial(QUANTILE_CENTRE_TOP, r) / polynomial(QUANTILE_CENTRE_BOTTOM, r)
    t = F.sqrt(-F.log(F.least(p, 1.0 - p))) - 1.6
    tail = polynomial(QUANTILE_TAIL_TOP, t) / polynomial(QUANTILE_TAIL_BOTTOM, t)
    return F.when(F.abs(q) <= 0.425, centre).when(q < 0, -tail).otherwise(tail)


def upper_tail(z: Column) -> Column:
    """P(Z > z)."""
    a = F.abs(z)
    y = 0.5 * a * a
    near = 0.5 - a * (
        0.398942280444
        - 0.399903438504 * y / (y + 5.75885480458 - 29.8213557808 / (y + 2.62433121679 + 48.6959930692 / (y + 5.92885724438)))
    )
    inner = a + 3.99019417011
    inner = a + 0.742380924027 + 30.789933034 / inner
    inner = a + 4.8385912808 - 15.1508972451 / inner
    inner = a - 0.151679116635 + 5.29330324926 / inner
    inner = a + 3.98064794e-4 + 1.98615381364 / inner
    far = 0.398942280385 * F.exp(-y) / (a - 3.8052e-8 + 1.00000615302 / inner)
    area = F.when(a <= 1.28, near).when(a <= 38.0, far).otherwise(0.0)
    return F.when(z < 0, 1.0 - area).otherwise(area)
