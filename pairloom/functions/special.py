"""Tail probabilities for the rank tests, by NumPy quadrature; they see a few scalars per test."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution with an integer number of degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total = math.erfc(math.sqrt(half))
    term = math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (df - 1) // 2 + 1):
        total += math.exp(-half) * term
        term *= half / (i + 0.5)
    return min(1.0, total)


@lru_cache(maxsize=1)
def _grid() -> tuple[np.ndarray, np.ndarray]:
    nodes, weights = np.polynomial.legendre.leggauss(200)
    return nodes * 9.0, weights * 9.0


_erf = np.vectorize(math.erf, otypes=[float])


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _erf(z / math.sqrt(2.0)))


def studentized_range_sf(q: float, k: int) -> float:
    """P(range of k standard normals > q): infinite degrees of freedom."""
    if q <= 0:
        return 1.0
    z, w = _grid()
    density = np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)
    inner = np.clip(_normal_cdf(z) - _normal_cdf(z - q), 0.0, 1.0) ** (k - 1)
    return float(min(1.0, max(0.0, 1.0 - k * np.sum(w * density * inner))))


@lru_cache(maxsize=256)
def studentized_range_ppf(p: float, k: int) -> float:
    """Quantile by bisection."""
    low, high = 0.0, 50.0
    for _ in range(100):
        mid = (low + high) / 2.0
        if 1.0 - studentized_range_sf(mid, k) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0
