"""Tail probabilities as Spark column expressions (no Python worker), applied to reduced rows.

Spark SQL has no erfc and no incomplete beta function. Both are continued fractions, evaluated
from their last term backwards by ``aggregate`` over a constant sequence, so small p-values keep
their digits: a tail is computed as itself, never as one minus the rest.

normal:  p = erfc(|z| / sqrt 2): Laplace's continued fraction from |z| = 2 on, below it one
         minus the all-positive series of erf.
beta:    I_x(a, b), the regularized incomplete beta function: its continued fraction on the side
         where that converges, the mirrored one on the other.
Student: p = I_{v/(v+t^2)}(v/2, 1/2); from BIG_DOF degrees of freedom on, Hill's expansion turns
         t into the normal deviate of the same tail.

Relative error is below 1e-9 down to p = 1e-30 (``tests/test_stats.py``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Lanczos approximation, g = 7, nine coefficients (published constants)
_LANCZOS_G = 7.0
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028,
            771.32342877765313, -176.61502916214059, 12.507343278686905,
            -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]

#: Terms of the normal law's fraction, and pairs of terms of the incomplete beta function's, which
#: needs about sqrt(max(a, b)) of them.
TERMS, PAIRS = 100, 100
#: Degrees of freedom, or beta weights, from which the expansions around the normal law take over.
BIG_DOF = 10_000.0


def _let(body, **values: Column) -> Column:
    """``body`` of the named values, each evaluated once."""
    one = F.array(F.struct(*[v.cast("double").alias(k) for k, v in values.items()]))
    return F.element_at(F.transform(one, lambda v: body(*[v[k] for k in values])), 1)


def _lgamma_pos(x: Column) -> Column:
    """log Γ(x) for x ≥ 0.5 (Lanczos)."""
    xm = x - F.lit(1.0)
    places = F.sequence(F.lit(1), F.lit(len(_LANCZOS) - 1))
    terms = F.array(*[F.lit(c) for c in _LANCZOS[1:]])
    a = F.aggregate(F.zip_with(terms, places, lambda c, i: c / (xm + i)), F.lit(_LANCZOS[0]), lambda acc, c: acc + c)
    t = xm + F.lit(_LANCZOS_G + 0.5)
    return (F.lit(0.5 * math.log(2 * math.pi)) + (xm + F.lit(0.5)) * F.log(t) - t + F.log(a))


def lgamma_col(x: Column) -> Column:
    """log Γ(x) for x > 0, by Γ(x + 1) = x Γ(x)."""
    return _let(lambda v: _lgamma_pos(v + F.lit(1.0)) - F.log(v), x=x)


def _backwards(terms: int, start: float, step) -> Column:
    """``step(acc, k)`` for k = terms … 1, from ``start``."""
    ks = F.transform(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), lambda k: k.cast("double"))
    return F.aggregate(ks, F.lit(start), step)


def _clamp01(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def normal_p_col(z: Column) -> Column:
    """Two-sided p of a standard-normal statistic: erfc(|z| / sqrt 2)."""
    def body(x):
        density = F.exp(-x * x) / F.lit(math.sqrt(math.pi))
        tail = density / (x + _backwards(TERMS, 0.0, lambda acc, k: k / F.lit(2.0) / (x + acc)))
        # erf x = 2 x exp(-x^2) / sqrt(pi) * (1 + 2x^2/3 (1 + 2x^2/5 (1 + ...)))
        series = _backwards(60, 1.0, lambda acc, k: F.lit(1.0) + F.lit(2.0) * x * x / (F.lit(2.0) * k + F.lit(1.0)) * acc)
        return F.when(x >= F.lit(math.sqrt(2)), tail).otherwise(F.lit(1.0) - F.lit(2.0) * x * density * series)

    return _clamp01(_let(body, x=F.abs(z) / F.lit(math.sqrt(2))))


def _beta_fraction(x: Column, y: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) by its continued fraction, for x below about a / (a + b); y is 1 - x."""
    def pair(acc, m):  # the terms 2m - 1 and 2m
        odd = (a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -odd / (F.lit(1.0) + even / (F.lit(1.0) + acc))

    gammas = F.zip_with(F.array(a + b, a, b), F.array(F.lit(1.0), F.lit(-1.0), F.lit(-1.0)), lambda v, sign: sign * lgamma_col(v))
    front = F.aggregate(gammas, a * F.log(x) + b * F.log(y), lambda acc, g: acc + g)
    return F.exp(front) / a / (F.lit(1.0) + _backwards(PAIRS, 0.0, pair))


def _beta_exact(x: Column, y: Column, a: Column, b: Column) -> Column:
    """I_x(a, b), by the fraction of the side on which it converges."""
    def body(x, y, a, b):
        near = x * (a + b + 2) < a + 1
        pick = lambda u, v: F.when(near, u).otherwise(v)
        share = _let(_beta_fraction, x=pick(x, y), y=pick(y, x), a=pick(a, b), b=pick(b, a))
        return _let(lambda p, n: F.when(n > 0, p).otherwise(F.lit(1.0) - p), p=share, n=near)

    return _let(body, x=x, y=y, a=a, b=b)


def beta_share_col(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b), the share of a Beta(a, b) law below x, for a, b > 0. From BIG_DOF on for a + b, the
    normal law of the same mean and variance (the skewness is then below 0.02 unless the mean is
    within 0.01 of 0 or 1)."""
    def body(x, a, b):
        n = a + b
        z = (x - a / n) * n * F.sqrt((n + 1) / (a * b))
        big = _let(lambda z, p: F.when(z < 0, p / 2).otherwise(F.lit(1.0) - p / 2), z=z, p=normal_p_col(z))
        inside = F.when(n < BIG_DOF, _beta_exact(x, F.lit(1.0) - x, a, b)).otherwise(big)
        return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(_clamp01(inside))

    return _let(body, x=x, a=a, b=b)


def _normal_deviate(t: Column, dof: Column) -> Column:
    """Hill's expansion: the normal deviate with the tail of Student's t (dof large)."""
    def body(w, b):
        w3, w5, w7 = w * w * w, F.pow(w, F.lit(5.0)), F.pow(w, F.lit(7.0))
        last = (F.lit(4.0) * w7 + F.lit(33.0) * w5 + F.lit(240.0) * w3 + F.lit(855.0) * w) \
            / (F.lit(10.0) * b * (b + F.lit(0.8) * w3 * w + F.lit(100.0)))
        return w + (w3 + F.lit(3.0) * w) / b - last

    a = dof - F.lit(0.5)
    return _let(body, w=F.sqrt(a * F.log1p(t * t / dof)), b=F.lit(48.0) * a * a)


def student_p_col(t: Column, dof: Column) -> Column:
    """Two-sided p of a Student-t statistic with ``dof`` (real) degrees of freedom."""
    def body(t, v):
        exact = _beta_exact(v / (t * t + v), t * t / (t * t + v), v / 2, F.lit(0.5))
        p = F.when(v < BIG_DOF, exact).otherwise(normal_p_col(_normal_deviate(t, v)))
        return F.when(t == 0, F.lit(1.0)).otherwise(_clamp01(p))

    return _let(body, t=t, v=dof)


def p_value_col(kind: Column, stat: Column, dof: Column) -> Column:
    """'z' → normal law, 't' → Student's t; null statistic → null p."""
    return F.when(stat.isNull(), F.lit(None).cast("double")) \
        .when(kind == F.lit("z"), normal_p_col(stat)) \
        .otherwise(student_p_col(stat, dof))
