"""Exact two-sided p-values the tests compare the Spark expressions with."""

import math


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def beta_share(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta I_x(a, b) by its power series around 0 (DLMF 8.17.7 with
    Kummer's form 8.17.8: all terms positive), mirrored where that converges slowly."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(1.0 - x, b, a)
    total = term = 1.0
    n = 0
    while term > 1e-17 * total:
        term *= x * (a + b + n) / (a + 1.0 + n)
        total += term
        n += 1
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(log_front) / a * total


def student_p(t: float, df: float) -> float:
    return beta_share(df / (df + t * t), df / 2.0, 0.5)
