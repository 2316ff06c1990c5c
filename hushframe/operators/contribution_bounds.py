"""DP choice of the bound on partitions a privacy unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mechanisms import ExponentialMechanism, Sensitivities, additive_mechanism
from ..params import CalculatePrivateContributionBoundsParams
from .histograms import FrequencyBin, frequency_bins


def generate_possible_contribution_bounds(upper_bound: int) -> list[int]:
    """1, 2, ..., 999, 1000, 1010, ..., 9990, 10000, 10100, ...: three leading digits."""
    out, step, at = [], 1, 1
    while at <= upper_bound:
        out.append(at)
        at += step
        if at == step * 1000:
            step *= 10
    return out


class L0ScoringFunction(ExponentialMechanism.ScoringFunction):
    """score(k): minus half the noise over all partitions and half the contributions
    that a bound k drops."""

    is_monotonic = True

    def __init__(self, params: CalculatePrivateContributionBoundsParams, number_of_partitions: int, bins: list[FrequencyBin]):
        self.params, self.partitions, self.bins = params, number_of_partitions, bins
        self.global_sensitivity = self.bound = min(params.max_partitions_contributed_upper_bound, number_of_partitions)

    def score(self, k: int) -> float:
        p = self.params
        noise = additive_mechanism(p.aggregation_noise_kind, p.aggregation_eps, p.aggregation_delta, Sensitivities(l0=k, linf=1)).std
        dropped = sum(max(min(b.lower, self.bound) - k, 0) * b.count for b in self.bins)
        return -0.5 * self.partitions * noise - 0.5 * dropped


def choose_l0(pairs: DataFrame, keys: list[str], partitions: int, params: CalculatePrivateContributionBoundsParams) -> int:
    """``pairs``: (pid, keys) rows, repeats allowed.  Only the histogram comes to the driver."""
    per_unit = pairs.distinct().groupBy("pid").agg(F.count("*").alias("v"))
    scoring = L0ScoringFunction(params, partitions, frequency_bins(per_unit, "v"))
    candidates = generate_possible_contribution_bounds(scoring.bound)
    return ExponentialMechanism(scoring).apply(params.calculation_eps, candidates)
