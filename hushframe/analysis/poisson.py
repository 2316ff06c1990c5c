"""Distribution of the number of units that stay in a partition after bounding."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from ..mechanisms import phi


@dataclass
class PMF:
    """Probabilities of start, start + 1, ..."""

    start: int
    probabilities: np.ndarray


def compute_pmf(probabilities: Sequence[float]) -> PMF:
    """Exact distribution of a sum of independent 0/1 variables: the product of their
    generating polynomials, multiplied pairwise."""
    factors = [np.array([1 - p, p]) for p in probabilities] or [np.ones(1)]
    while len(factors) > 1:
        odd = factors[len(factors) & ~1 :]
        factors = [np.convolve(a, b) for a, b in zip(factors[::2], factors[1::2])] + odd
    return PMF(0, factors[0])


def compute_exp_std_skewness(probabilities: Sequence[float]) -> tuple[float, float, float]:
    """From the first three cumulants, which add up over independent variables."""
    p = np.asarray(probabilities, float)
    q = 1 - p
    first, second, third = np.stack([p, p * q, p * q * (q - p)]).sum(axis=1)
    return float(first), math.sqrt(second), float(third / second**1.5)


def compute_pmf_approximation(mean: float, sigma: float, skewness: float, n: int) -> PMF:
    """Refined normal approximation, within 8 deviations of the mean."""
    if sigma == 0:
        return PMF(round(mean), np.ones(1))
    start, end = max(0, math.floor(mean - 8 * sigma)), min(n, round(mean + 8 * sigma))
    x = (np.arange(start - 1, end + 1) + 0.5 - mean) / sigma
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([phi(v) for v in x]) + skewness * (1 - x * x) * density / 6
    return PMF(start, np.diff(np.clip(cdf, 0, 1)))


def _scaled_tail(z: float) -> float:
    """exp(z * z / 2) times the normal probability above z, for z >= 0."""
    if z < 25:
        return math.exp(z * z / 2) * 0.5 * math.erfc(z / math.sqrt(2))
    tail = 0.0
    for k in range(12, 0, -1):  # continued fraction of the tail
        tail = k / (z + tail)
    return 1 / ((z + tail) * math.sqrt(2 * math.pi))


def laplace_gaussian_cdf(x: float, laplace_b: float, gaussian_sigma: float) -> float:
    """P(X + Y <= x) of a Laplace X and a normal Y, in closed form: the normal probability,
    less what the two exponential tails take on one side and give on the other."""
    b, s = laplace_b, gaussian_sigma
    if s == 0:
        return 0.5 * math.exp(x / b) if x < 0 else 1 - 0.5 * math.exp(-x / b)
    if b == 0:
        return phi(x / s)

    def side(x: float) -> float:  # exp(s^2 / 2b^2 - x / b) * phi(x / s - s / b)
        z = s / b - x / s
        if z >= 0:
            return math.exp(-x * x / (2 * s * s)) * _scaled_tail(z)
        return math.exp(s * s / (2 * b * b) - x / b) * phi(-z)

    return min(1.0, max(0.0, phi(x / s) - 0.5 * (side(x) - side(-x))))


def compute_sum_laplace_gaussian_quantiles(laplace_b: float, gaussian_sigma: float, quantiles: Sequence[float], num_samples: int | None = None) -> list[float]:
    """Quantiles of a Laplace plus a Gaussian variable, by bisection of the closed form to a
    1e-12th of their deviation.  ``num_samples`` has no effect: nothing is sampled."""
    spread = math.hypot(math.sqrt(2) * laplace_b, gaussian_sigma)
    out = []
    for q in quantiles:
        if not 0 < q < 1:
            out.append(math.copysign(math.inf, q - 0.5))
            continue
        if q > 0.5:  # tails are exact on the left
            out.append(-compute_sum_laplace_gaussian_quantiles(laplace_b, gaussian_sigma, [1 - q])[0])
            continue
        low, high = -spread, spread
        while laplace_gaussian_cdf(low, laplace_b, gaussian_sigma) > q:
            low *= 2
        while high - low > 1e-12 * spread:
            middle = (low + high) / 2
            low, high = (middle, high) if laplace_gaussian_cdf(middle, laplace_b, gaussian_sigma) < q else (low, middle)
        out.append((low + high) / 2)
    return out
