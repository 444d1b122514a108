"""Upper tail of the studentized range as a column expression.

The range of k means is integrated over the pooled deviation: two nested Gauss-Legendre sums,
their nodes and weights made once from the rule and put into the plan as constants.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

OUTER, INNER = 48, 64
REACH = 8.0  # standard deviations of the inner integral

# Hart's rational approximation of the normal distribution function.
HART_ABOVE = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_BELOW = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
              793.826512519948, 440.413735824752]
HART_END = 7.07106781186547


def _poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, to about 1e-14; zero or one beyond seven deviations."""
    a = F.least(F.abs(x), F.lit(HART_END))
    tail = F.exp(-a * a / 2) * _poly(HART_ABOVE, a) / _poly(HART_BELOW, a)
    tail = F.when(F.abs(x) >= HART_END, 0.0).otherwise(tail)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def nodes(n: int) -> tuple[list[float], list[float]]:
    """Nodes and weights on -1..1."""
    x, w = np.polynomial.legendre.leggauss(n)
    return x.tolist(), w.tolist()


def inner_nodes() -> tuple[list[float], list[float], list[float]]:
    """Nodes of the inner sum, their weights times the normal density, and the distribution function there."""
    x, w = nodes(INNER)
    z = [REACH * v for v in x]
    weight = [REACH * u * math.exp(-v * v / 2) / math.sqrt(2 * math.pi) for u, v in zip(w, z)]
    return z, weight, [0.5 * math.erfc(-v / math.sqrt(2)) for v in z]


def studentized_range_tail(q: Column, k: Column, df: Column) -> Column:
    """P(Q > q) for k means and df error degrees of freedom; null where it is not defined."""
    z, weight, below = inner_nodes()
    table = F.lit([list(t) for t in zip(z, weight, below)])

    def within(width: Column) -> Column:
        """Probability that the range of k means is at most ``width`` deviations."""

        def add(total: Column, t: Column) -> Column:
            inside = F.greatest(t[2] - normal_cdf(t[0] - width), F.lit(0.0))
            return total + t[1] * F.pow(inside, k - 1)

        return k * F.aggregate(table, F.lit(0.0), add)

    spread = 1 / F.sqrt(2 * df)
    low = F.greatest(F.lit(1e-9), 1 - 10 * spread)
    high = 1 + F.when(df > 4, 10).otherwise(14) * spread
    steps = F.lit([list(t) for t in zip(*nodes(OUTER))])

    def add(sums: Column, t: Column) -> Column:
        s = (high + low) / 2 + (high - low) / 2 * t[0]
        # The density of the deviation up to a constant, which the second sum takes out.
        density = t[1] * F.exp((df - 1) * F.log(s) - df * (s * s - 1) / 2)
        return F.struct((sums["a"] + density * within(q * s)).alias("a"), (sums["b"] + density).alias("b"))

    both = F.aggregate(steps, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), add, lambda s: 1 - s["a"] / s["b"])
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), both))
    finite = q.isNotNull() & ~F.isnan(q) & (q < math.inf)
    return F.when(finite & (k >= 2) & (df >= 1), F.when(q <= 0, 1.0).otherwise(p))
