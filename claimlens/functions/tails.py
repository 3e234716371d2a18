"""Tail probability of Student's t distribution, for one-row test results."""

from __future__ import annotations

import math

import numpy as np

_POINTS, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def _log_gamma_step(a: float) -> float:
    """log gamma(a + 1/2) - log gamma(a), without the cancellation of the two for large ``a``."""
    down = 0.0
    while a < 32.0:
        down += math.log(a / (a + 0.5))
        a += 1.0
    u = 1.0 / a
    return down + 0.5 * math.log(a) - u / 8 + u**3 / 192 - u**5 / 640 + 17 * u**7 / 14336


def two_sided_t(t: float, df: float) -> float:
    """Probability that a t variable with ``df`` >= 1 degrees of freedom is at least as far from 0 as ``t``.

    With t = sqrt(df) tan(phi) the density is a power of the cosine. It is integrated from ``t`` to the end of the
    quarter circle over stretches that start as short as the density falls and grow from there, by one rule for
    every ``df``.
    """
    if math.isnan(t) or math.isnan(df) or df < 1:
        return math.nan
    if math.isinf(t):
        return 0.0
    if t == 0:
        return 1.0
    low, end = math.atan2(abs(t), math.sqrt(df)), math.pi / 2
    width = 0.25 / (math.sqrt(df) * max(1.0, abs(t)))
    # The density over its value at ``t``, so that a far tail does not vanish before it is summed.
    start = math.log1p(t * t / df)
    total = 0.0
    while low < end:
        high = min(low + width, end)
        phi = (low + high) / 2 + (high - low) / 2 * _POINTS
        fall = np.log1p(-np.minimum(np.sin(phi) ** 2, 1.0 - 1e-300)) + start
        part = float((high - low) / 2 * (_WEIGHTS * np.exp((df - 1) / 2 * fall)).sum())
        total += part
        if part < 1e-18 * total:
            break
        low, width = high, width * 1.5
    log_tail = math.log(2 * total) + _log_gamma_step(df / 2) - 0.5 * math.log(math.pi) - (df - 1) / 2 * start
    return min(1.0, math.exp(log_tail))
