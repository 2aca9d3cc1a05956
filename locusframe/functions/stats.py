"""Statistical scalar functions as column expressions.

NaN is not a value here: sources turn it into null, and every function gives null for null.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300

#: Coefficients of the rational approximations of the normal quantile (Wichura 1988, AS 241, PPND16).
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _poly(c: tuple[float, ...], x: Column) -> Column:
    out = F.lit(c[-1])
    for k in reversed(c[:-1]):
        out = out * x + F.lit(k)
    return out


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal distribution; null outside (0, 1)."""
    q = p - 0.5
    near = 0.180625 - q * q
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    mid, far = r - 1.6, r - 5.0
    tail = F.when(r <= 5.0, _poly(_MIDDLE[0], mid) / _poly(_MIDDLE[1], mid)).otherwise(_poly(_TAIL[0], far) / _poly(_TAIL[1], far))
    out = F.when(F.abs(q) <= 0.425, q * _poly(_CENTRE[0], near) / _poly(_CENTRE[1], near)).otherwise(F.when(q < 0, -tail).otherwise(tail))
    return F.when((p > 0) & (p < 1), out)


def clip(x: Column, low: float, high: float) -> Column:
    """Bounded x; unlike ``least`` and ``greatest`` null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def neglog10(p: Column) -> Column:
    return -F.log10(clip(p, TINY, 1.0))


def acat(p: Column, q: Column) -> Column:
    """Cauchy combination of two p-values."""
    a, b = (clip(x, 1e-15, 1 - 1e-15) for x in (p, q))
    t = 0.5 * (F.tan((0.5 - a) * pi) + F.tan((0.5 - b) * pi))
    return clip(0.5 - F.atan(t) / pi, TINY, 1.0)


def simes(p: Column, q: Column) -> Column:
    """Simes combination of two p-values."""
    low, high = F.when(p <= q, p).otherwise(q), F.when(p <= q, q).otherwise(p)
    both = F.when(2 * low <= high, 2 * low).otherwise(high)
    return F.when(p.isNotNull() & q.isNotNull(), clip(both, TINY, 1.0))


def chi2_1_isf(p: Column) -> Column:
    """Chi-square value with one degree of freedom that is exceeded with probability p."""
    z = norm_ppf(clip(p, TINY, 1.0) / 2)
    return z * z


#: Median of the chi-square distribution with one degree of freedom.
CHI2_1_MEDIAN = 0.4549364231195727


def interval(beta: Column, se: Column) -> tuple[Column, Column]:
    """95 % Wald interval."""
    return beta - 1.96 * se, beta + 1.96 * se


def same_sign(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)


def close(a: Column, b: Column) -> Column:
    """Equal up to 1e-8 + 1e-5 |b|; nulls equal each other."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b))
