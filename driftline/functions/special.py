"""Special functions that the installed libraries lack, for arrays."""

from __future__ import annotations

import math

import numpy as np

_ERF = np.frompyfunc(math.erf, 1, 1)
_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)


def ndtr(x):
    """Standard normal distribution function."""
    if np.size(x) > 64:  # equal values, common in ranks and held windows, once
        each, back = np.unique(np.asarray(x, float), return_inverse=True)
        if len(each) < np.size(x) / 2:
            return ndtr(each)[back].reshape(np.shape(x))
    return 0.5 * (1 + _ERF(np.asarray(x, float) / math.sqrt(2)).astype(float))


def gammaln(x):
    return _LGAMMA(np.asarray(x, float)).astype(float)


def ndtri(p):
    """Its inverse on (0, 1): a rational start, then two Halley steps to full precision."""
    p = np.asarray(p, float)
    q = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(q))
    x = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3))
    for _ in range(3):
        e = ndtr(x) - q
        u = e * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
        x = x - u / (1 + x * u / 2)
    return np.where(p < 0.5, x, -x)
