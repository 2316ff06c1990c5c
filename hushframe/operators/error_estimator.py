"""Error of a metric for given bounds, estimated from dataset histograms."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

from ..mechanisms import Sensitivities, additive_mechanism
from ..params import Metric, Metrics, NoiseKind, require
from .histograms import DatasetHistograms, Histogram, compute_ratio_dropped


def _interpolated(points: Sequence[tuple[float, float]], bound: float) -> float:
    """Dropped share at a bound, linear between the histogram's points."""
    if bound <= 0:
        return 1.0
    xs = [x for x, _ in points]
    i = bisect_left(xs, bound)
    if i == len(xs):
        return 0.0
    if xs[i] == bound:
        return points[i][1]
    (x0, y0), (x1, y1) = points[i - 1], points[i]
    return y0 + (y1 - y0) * (bound - x0) / (x1 - x0)


@dataclass
class ErrorEstimator:
    base_std: float
    metric: Metric
    noise: NoiseKind
    l0_ratios: list[tuple[float, float]]
    linf_ratios: list[tuple[float, float]]
    partition_histogram: Histogram

    def get_ratio_dropped_l0(self, bound: float) -> float:
        return _interpolated(self.l0_ratios, bound)

    def get_ratio_dropped_linf(self, bound: float) -> float:
        return _interpolated(self.linf_ratios, bound)

    def estimate_rmse(self, l0_bound: int, linf_bound: float | None = None) -> float:
        """Root of the squared dropped part and noise, averaged over partitions."""
        require(self.metric == Metrics.PRIVACY_ID_COUNT or linf_bound is not None, "linf must be given for COUNT and SUM")
        linf = 1.0 if self.metric == Metrics.PRIVACY_ID_COUNT else float(linf_bound)
        lost_linf = 0.0 if self.metric == Metrics.PRIVACY_ID_COUNT else self.get_ratio_dropped_linf(linf)
        dropped = 1 - (1 - self.get_ratio_dropped_l0(l0_bound)) * (1 - lost_linf)
        std = self.base_std * linf * (l0_bound if self.noise is NoiseKind.LAPLACE else math.sqrt(l0_bound))
        bins = self.partition_histogram.bins
        return sum(b.count * math.sqrt((dropped * b.sum / b.count) ** 2 + std**2) for b in bins) / self.partition_histogram.total_count()


def _base_std(kind: NoiseKind, epsilon: float, delta: float | None) -> float:
    require(kind is not NoiseKind.GAUSSIAN or bool(delta), "delta must be given for Gaussian noise")
    return additive_mechanism(kind, epsilon, delta or 0.0, Sensitivities(l0=1, linf=1)).std


def create_estimator_for_count_and_privacy_id_count(histograms: DatasetHistograms, epsilon: float, delta: float | None, metric: Metric, noise: NoiseKind) -> ErrorEstimator:
    require(metric in (Metrics.COUNT, Metrics.PRIVACY_ID_COUNT), f"Only COUNT and PRIVACY_ID_COUNT are supported, but {metric} given.")
    sizes = histograms.count_per_partition_histogram if metric == Metrics.COUNT else histograms.count_privacy_id_per_partition
    return ErrorEstimator(_base_std(noise, epsilon, delta), metric, noise, compute_ratio_dropped(histograms.l0_contributions_histogram), compute_ratio_dropped(histograms.linf_contributions_histogram), sizes)


def create_estimator_for_sum(histograms: DatasetHistograms, epsilon: float, delta: float | None, noise: NoiseKind) -> ErrorEstimator:
    require(histograms.linf_sum_contributions_histogram.bins[0].lower >= 0, "The error for SUM of negative values can't be estimated.")
    return ErrorEstimator(_base_std(noise, epsilon, delta), Metrics.SUM, noise, compute_ratio_dropped(histograms.l0_contributions_histogram), compute_ratio_dropped(histograms.linf_sum_contributions_histogram), histograms.sum_per_partition_histogram)
