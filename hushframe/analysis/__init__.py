"""Utility analysis and parameter tuning without running DP."""

from .preaggregate import preaggregate
from .summary import PublicPartitionsSummary, compute_public_partitions_summary
from .tuning import DPStrategySelector, MinimizingFunction, ParametersToTune, TuneOptions, TuneResult, tune
from .utility import MultiParameterConfiguration, UtilityAnalysisOptions, UtilityReport, perform_utility_analysis

__all__ = [
    "DPStrategySelector", "MinimizingFunction", "MultiParameterConfiguration", "ParametersToTune", "PublicPartitionsSummary", "TuneOptions", "TuneResult",
    "UtilityAnalysisOptions", "UtilityReport", "compute_public_partitions_summary", "perform_utility_analysis", "preaggregate", "tune",
]
