"""Private partition selection: which groups may be published, from unit counts."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from .mechanisms import GaussianMechanism, LaplaceMechanism, compute_sigma, gaussian_epsilon, phi, secure_rng
from .params import PartitionSelectionStrategy, check_positive_int, require

_NORMAL = NormalDist()


def adjusted_delta(delta: float, l0: int) -> float:
    """Delta of one partition so that l0 partitions together spend ``delta``."""
    return -math.expm1(math.log1p(-delta) / l0)


class PartitionSelector:
    """Keeps partitions by their number of privacy units.

    With ``pre_threshold`` t, partitions of fewer than t units always go and the
    others are judged by n - (t - 1)."""

    epsilon: float
    delta: float
    threshold: float | None = None

    def __init__(self, pre_threshold: int | None = None):
        if pre_threshold is not None:
            check_positive_int(pre_threshold, "pre_threshold")
        self.pre_threshold = pre_threshold
        self.shift = (pre_threshold or 1) - 1

    def effective(self, count) -> np.ndarray:
        return np.maximum(np.asarray(count, float) - self.shift, 0)

    def probabilities(self, count) -> np.ndarray:
        n = self.effective(count)
        return np.where(n > 0, self._probabilities(n), 0.0)

    def probability_of_keep(self, count: float) -> float:
        return float(self.probabilities([count])[0])

    def keep(self, count) -> np.ndarray:
        """A secure random decision for each count."""
        return secure_rng().happens(self.probabilities(count))

    def should_keep(self, count: float) -> bool:
        return bool(self.keep([count])[0])

    def _probabilities(self, n: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class TruncatedGeometric(PartitionSelector):
    """The optimal selection of Desfontaines, Voss, Gipson and Mandayam (2022)."""

    def __init__(self, epsilon: float, delta: float, l0: int, pre_threshold: int | None = None):
        super().__init__(pre_threshold)
        self.epsilon, self.delta = epsilon, delta
        self.e, self.d = min(epsilon / l0, 700.0), adjusted_delta(delta, l0)
        # up to here probabilities grow by e ** epsilon, from here on they approach 1
        self.turn = 1 + math.floor(max(0.0, math.log((math.expm1(self.e) + 2 * self.d) / (self.d * (math.exp(self.e) + 1)))) / self.e)
        self.at_turn = self._growing(np.array([float(self.turn)]))[0]

    def _growing(self, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.minimum(self.d * np.expm1(n * self.e) / math.expm1(self.e), 1.0)

    def _probabilities(self, n: np.ndarray) -> np.ndarray:
        n = np.floor(n)
        limit = 1 + self.d / math.expm1(self.e)
        near = limit - np.exp(-np.maximum(n - self.turn, 0) * self.e) * (limit - self.at_turn)
        return np.where(n <= self.turn, self._growing(n), np.minimum(near, 1.0))


class Thresholding(PartitionSelector):
    """Noisy count against a threshold; can release the noisy count of what it keeps."""

    def noised_value_if_should_keep(self, count: float) -> float | None:
        return self.noised([count])[0]

    def noised(self, count) -> list[float | None]:
        """Noisy counts, None for partitions that go.  One draw serves both purposes."""
        n = self.effective(count)
        noisy = self.mechanism.add_noise(n)
        return [float(v) + self.shift if k > 0 and v >= self.threshold else None for k, v in zip(n, noisy)]

    def keep(self, count) -> np.ndarray:
        n = self.effective(count)
        return (n > 0) & (self.mechanism.add_noise(n) >= self.threshold)


class LaplaceThresholding(Thresholding):
    def __init__(self, epsilon: float, delta: float, l0: int, pre_threshold: int | None = None):
        super().__init__(pre_threshold)
        self.epsilon, self.delta = epsilon, delta
        self.mechanism = LaplaceMechanism(epsilon, l0)
        d, b = adjusted_delta(delta, l0), self.mechanism.diversity
        self.threshold = 1 - b * math.log(2 * d) if d <= 0.5 else 1 + b * math.log(2 * (1 - d))

    @classmethod
    def from_std(cls, normalized_stddev: float, thresholding_delta: float, l0: int, pre_threshold: int | None = None) -> "LaplaceThresholding":
        return cls(math.sqrt(2) / normalized_stddev, thresholding_delta, l0, pre_threshold)

    def _probabilities(self, n: np.ndarray) -> np.ndarray:
        z = (self.threshold - n) / self.mechanism.diversity
        return np.where(z >= 0, 0.5 * np.exp(-np.abs(z)), 1 - 0.5 * np.exp(-np.abs(z)))


class GaussianThresholding(Thresholding):
    """Half of delta is for the noise, half for the threshold."""

    def __init__(self, epsilon: float, delta: float, l0: int, pre_threshold: int | None = None, sigma: float | None = None, threshold_delta: float | None = None):
        super().__init__(pre_threshold)
        self.epsilon, self.delta = epsilon, delta
        sigma = compute_sigma(epsilon, delta / 2, math.sqrt(l0)) if sigma is None else sigma
        self.mechanism = GaussianMechanism(sigma, math.sqrt(l0), epsilon, delta)
        # as the upper tail is the lower one's mirror image, deltas far below 1e-16 count too
        self.threshold = 1 - sigma * _NORMAL.inv_cdf(adjusted_delta(delta / 2 if threshold_delta is None else threshold_delta, l0))

    @classmethod
    def from_std(cls, normalized_stddev: float, thresholding_delta: float, l0: int, pre_threshold: int | None = None) -> "GaussianThresholding":
        epsilon = gaussian_epsilon(normalized_stddev, thresholding_delta)
        return cls(epsilon, 2 * thresholding_delta, l0, pre_threshold, normalized_stddev * math.sqrt(l0), thresholding_delta)

    def _probabilities(self, n: np.ndarray) -> np.ndarray:
        return np.array([phi((x - self.threshold) / self.mechanism.std) for x in n])


def weighted_gaussian_thresholding(epsilon: float, delta: float, l0: int, pre_threshold: int | None = None) -> GaussianThresholding:
    """For sums of weights 1 / sqrt(k), whose l2 sensitivity is 1: the deviation for that
    sensitivity, used as that of a Gaussian thresholding over l0 partitions."""
    return GaussianThresholding.from_std(compute_sigma(epsilon, delta / 2, 1.0), delta / 2, l0, pre_threshold)


_BY_STRATEGY = {
    PartitionSelectionStrategy.TRUNCATED_GEOMETRIC: TruncatedGeometric,
    PartitionSelectionStrategy.LAPLACE_THRESHOLDING: LaplaceThresholding,
    PartitionSelectionStrategy.GAUSSIAN_THRESHOLDING: GaussianThresholding,
    PartitionSelectionStrategy.WEIGHTED_GAUSSIAN_THRESHOLDING: weighted_gaussian_thresholding,
}


def create_partition_selection_strategy(strategy: PartitionSelectionStrategy, epsilon: float, delta: float, max_partitions_contributed: int, pre_threshold: int | None = None) -> PartitionSelector:
    return _BY_STRATEGY[strategy](epsilon, delta, max_partitions_contributed, pre_threshold)


def create_partition_selector(strategy: PartitionSelectionStrategy, spec, max_partitions_contributed: int, pre_threshold: int | None = None) -> PartitionSelector:
    """From a mechanism spec, by deviation where the accountant set one."""
    if not spec.standard_deviation_is_set:
        return create_partition_selection_strategy(strategy, spec.eps, spec.delta, max_partitions_contributed, pre_threshold)
    by_std = {PartitionSelectionStrategy.LAPLACE_THRESHOLDING: LaplaceThresholding, PartitionSelectionStrategy.GAUSSIAN_THRESHOLDING: GaussianThresholding}
    require(strategy in by_std, f"{strategy.value} can't be made from a noise deviation")
    return by_std[strategy].from_std(spec.noise_standard_deviation, spec.thresholding_delta, max_partitions_contributed, pre_threshold)


def create_thresholding_mechanism(spec, l0: int, pre_threshold: int | None = None) -> Thresholding:
    """The thresholding mechanism that post-aggregation selection uses."""
    strategy = spec.mechanism_type.to_partition_selection_strategy()
    return create_partition_selector(strategy, spec, l0, pre_threshold)
