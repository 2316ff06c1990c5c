"""Differentially private analytics as ordinary Spark DataFrame plans."""

from .budget import Budget, NaiveBudgetAccountant, PLDBudgetAccountant
from .dataframes import QueryBuilder
from .engine import CustomCombiner, DPEngine, DPResult
from .extractors import DataExtractors, MultiValueDataExtractors, PreAggregateExtractors, of_row
from .params import (
    AddDPNoiseParams, AggregateParams, CalculatePrivateContributionBoundsParams, CountParams, MeanParams, MechanismType, Metrics, NoiseKind, NormKind,
    PartitionSelectionStrategy, PrivacyIdCountParams, PrivateContributionBounds, SelectPartitionsParams, SumParams, VarianceParams,
)
from .operators.quantiles import QuantileTree
from .plans.bounding import Sampling
from .plans.columnar import ColumnarCombiner
from .private_frame import PrivateCombineFn, PrivateDataFrame, make_private
from .report import ExplainComputationReport, register_annotator

__all__ = [
    "AddDPNoiseParams", "AggregateParams", "Budget", "CalculatePrivateContributionBoundsParams", "ColumnarCombiner", "CountParams", "CustomCombiner", "DPEngine", "DPResult", "DataExtractors",
    "ExplainComputationReport", "MeanParams", "MechanismType", "Metrics", "MultiValueDataExtractors", "NaiveBudgetAccountant", "NoiseKind", "NormKind", "PLDBudgetAccountant",
    "PartitionSelectionStrategy", "PreAggregateExtractors", "PrivacyIdCountParams", "PrivateCombineFn", "PrivateContributionBounds", "PrivateDataFrame", "QuantileTree", "QueryBuilder", "Sampling",
    "SelectPartitionsParams", "SumParams", "VarianceParams", "make_private", "of_row", "register_annotator",
]
