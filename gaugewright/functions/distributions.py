"""Distributions for a handful of values: tails, quantiles, the studentised range and the exact signed-rank null."""

from __future__ import annotations

import math

import numpy as np


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square: the recurrence of the incomplete gamma function from its value at one or two degrees of freedom."""
    if x <= 0:
        return 1.0
    h = x / 2
    a, q = (0.5, math.erfc(math.sqrt(h))) if df % 2 else (1.0, math.exp(-h))
    while a < df / 2:
        q += math.exp(a * math.log(h) - h - math.lgamma(a + 1))
        a += 1
    return min(1.0, q)


def t_two_sided(t: float, df: int) -> float:
    """Two-sided p-value of Student's t for whole degrees of freedom."""
    if math.isinf(t):
        return 0.0
    theta = math.atan(abs(t) / math.sqrt(df))
    c2, term, total = math.cos(theta) ** 2, 1.0, 1.0
    if df % 2 == 0:
        for j in range(1, df // 2):
            term *= (2 * j - 1) / (2 * j) * c2
            total += term
        return max(0.0, 1 - math.sin(theta) * total)
    for j in range(1, (df - 1) // 2):
        term *= 2 * j / (2 * j + 1) * c2
        total += term
    return max(0.0, 1 - 2 / math.pi * (theta + (math.sin(theta) * math.cos(theta) * total if df > 1 else 0.0)))


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection on its tail."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) / 2 > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) / 2 > 1 - p else (low, mid)
    return (low + high) / 2


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def studentized_range_sf(q: float, k: int) -> float:
    """Upper tail of the range of k standard normals."""
    z = 8 * _NODES
    density = np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([norm_cdf(x) for x in z])
    below = np.array([norm_cdf(x - q) for x in z])
    return float(min(1.0, max(0.0, 1 - 8 * k * np.sum(_WEIGHTS * density * (cdf - below) ** (k - 1)))))


def nemenyi_q(k: int, alpha: float = 0.05) -> float:
    """Critical value of the Nemenyi test for k models: that of the studentised range over the root of two."""
    low, high = 0.0, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if studentized_range_sf(mid, k) > alpha else (low, mid)
    return low / math.sqrt(2)


def wilcoxon(differences: list[float]) -> tuple[float, float, str]:
    """(W, two-sided p, mode) of the signed-rank test without zero differences.

    Exact for up to 50 differences without ties or zeros, else normal with correction for ties; no
    difference at all gives (0, 1).
    """
    d = np.array([x for x in differences if x != 0], float)
    n = len(d)
    if not n:
        return 0.0, 1.0, "none"
    size = np.abs(d)
    order = np.argsort(size, kind="stable")
    ranks = np.empty(n)
    values, counts = np.unique(size, return_counts=True)
    ends = np.cumsum(counts)
    ranks[order] = np.repeat(ends - (counts - 1) / 2, counts)
    plus = float(ranks[d > 0].sum())
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and len(values) == n and n == len(differences):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return w, float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n)), "exact"
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - float((counts**3 - counts).sum()) / 48)
    return w, float(min(1.0, 2 * norm_cdf((w - n * (n + 1) / 4) / spread))), "normal"


def bootstrap_interval(values: list[float], *, resamples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of the mean over resamples with replacement."""
    x = np.asarray(values, float)
    means = np.random.default_rng(seed).choice(x, size=(resamples, len(x)), replace=True).mean(axis=1)
    tail = (1 - confidence) / 2
    return float(np.quantile(means, tail)), float(np.quantile(means, 1 - tail))
