"""Tail probabilities as column expressions (Simpson sums over ``sequence``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

INTERVALS = 2000


def _simpson(low: Column, high: Column, f) -> Column:
    step = (high - low) / INTERVALS
    weight = lambda i: F.when((i == 0) | (i == INTERVALS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(INTERVALS)),
        F.lit(0.0),
        lambda s, i: s + weight(i) * f(low + i * step),
    )
    return total * step / 3


def f_tail(stat: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution.

    With v = atan(sqrt(d1 F / d2)) the tail is the share of the integral of
    cos(v)^(d2-1) sin(v)^(d1-1) beyond v. The integrand is taken relative to its
    maximum, and the nodes lie within some widths of it, so any degrees of freedom do.
    """
    d1, d2 = d1.cast("double"), d2.cast("double")
    power = lambda x, d: F.when(d == 1, 0.0).otherwise((d - 1) * F.log(F.greatest(x, F.lit(1e-300))))
    log_body = lambda v: power(F.cos(v), d2) + power(F.sin(v), d1)
    peak = F.when(d1 == 1, 0.0).when(d2 == 1, math.pi / 2).otherwise(F.atan(F.sqrt((d1 - 1) / (d2 - 1))))
    width = 9 / F.sqrt(F.greatest(d1 + d2 - 2, F.lit(1.0)))
    low, high = F.greatest(F.lit(0.0), peak - width), F.least(F.lit(math.pi / 2), peak + width)
    top = log_body(peak)
    start = F.greatest(F.atan(F.sqrt(d1 * stat / d2)), low)
    body = lambda v: F.exp(log_body(v) - top)
    share = _simpson(start, high, body) / _simpson(low, high, body)
    return (
        F.when(stat.isNull() | (d2 <= 0) | (d1 <= 0), None)
        .when(start >= high, 0.0)
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
    )


def t_tail(stat: Column, df: Column) -> Column:
    """Two-sided tail of Student's t."""
    return f_tail(stat * stat, F.lit(1), df)


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal."""
    a = F.abs(z)
    tail = _simpson(a, a + 12, lambda x: F.exp(-x * x / 2)) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, tail).otherwise(1 - tail)


# Coefficients of Wichura's algorithm AS 241 (normal quantile).
_CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
_MIDDLE = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
_FAR = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def _ratio(pair, x: Column) -> Column:
    return _poly(pair[0], x) / _poly(pair[1], x)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function (AS 241)."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    side = F.when(r <= 5, _ratio(_MIDDLE, r - 1.6)).otherwise(_ratio(_FAR, r - 5))
    centre = q * _ratio(_CENTRE, F.lit(0.180625) - q * q)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * side)


def mcnemar_exact(yn: Column, ny: Column) -> Column:
    """Two-sided exact binomial p of McNemar's test, for any number of pairs.

    The binomial tail at one half, P(X <= m) of n, is the F tail at (n - m) / (m + 1)
    with 2 (m + 1) and 2 (n - m) degrees of freedom.
    """
    n, m = yn + ny, F.least(yn, ny)
    tail = f_tail((n - m) / (m + 1), 2 * (m + 1), 2 * (n - m))
    # From half of the pairs on the tail is one half or more.
    return F.when(2 * m + 1 >= n, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
