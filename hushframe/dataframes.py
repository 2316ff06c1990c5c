"""A fluent query builder for DP aggregates of DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from .budget import Budget, NaiveBudgetAccountant
from .engine import DPEngine
from .extractors import DataExtractors
from .params import AggregateParams, Metric, Metrics, NoiseKind, NormKind, require
from .plans.bounding import Sampling
from .report import ExplainComputationReport


@dataclass
class Columns:
    privacy_key: str
    partition_key: str | Sequence[str]
    value: str | None


@dataclass
class ContributionBounds:
    max_partitions_contributed: int
    max_contributions_per_partition: int
    min_value: float | None = None
    max_value: float | None = None


@dataclass
class _Wanted:
    metric: Metric
    name: str
    column: str | None = None
    low: float | None = None
    high: float | None = None


@dataclass
class Query:
    """Built by ``QueryBuilder.build_query``."""

    df: DataFrame
    columns: Columns
    bounds: ContributionBounds
    names: dict[Metric, str]
    public_keys: Any = None
    vector: dict[str, Any] | None = None

    def run_query(self, budget: Budget, noise_kind: NoiseKind = NoiseKind.LAPLACE, out_explain_computation_report: ExplainComputationReport | None = None, sampling: Sampling = Sampling()) -> DataFrame:
        """The released rows: key columns as in the input and one column a metric."""
        accountant = NaiveBudgetAccountant(budget.epsilon, budget.delta)
        b = self.bounds
        params = AggregateParams(
            metrics=list(self.names), noise_kind=noise_kind, max_partitions_contributed=b.max_partitions_contributed,
            max_contributions_per_partition=b.max_contributions_per_partition, min_value=b.min_value, max_value=b.max_value, **(self.vector or {}),
        )
        extractors = DataExtractors(self.columns.privacy_key, self.columns.partition_key, self.columns.value)
        result = DPEngine(accountant, sampling).aggregate(self.df, params, extractors, self.public_keys, out_explain_computation_report)
        accountant.compute_budgets()
        out = result.to_df()
        for metric, name in self.names.items():
            out = out.withColumnRenamed(metric.column, name)
        return out


class QueryBuilder:
    """``QueryBuilder(df, "user").groupby(...).count().sum(...).build_query().run_query(Budget(1, 1e-6))``"""

    def __init__(self, df: DataFrame, privacy_unit_column: str):
        if not isinstance(df, DataFrame):
            raise NotImplementedError(f"Data frames of type {type(df)} are not supported")
        require(privacy_unit_column in df.columns, f"Column {privacy_unit_column} is not present in DataFrame")
        self._df, self._privacy = df, privacy_unit_column
        self._by: list[str] | None = None
        self._wanted: list[_Wanted] = []
        self._vector: dict[str, Any] | None = None

    def groupby(self, by: str | Sequence[str], *, max_groups_contributed: int, max_contributions_per_group: int, public_keys: DataFrame | Iterable[Any] | None = None) -> "QueryBuilder":
        require(self._by is None, "groupby can be called only once.")
        by = [by] if isinstance(by, str) else list(by)
        missing = [c for c in by if c not in self._df.columns]
        require(not missing, f"Column {missing[0] if missing else ''} is not present in DataFrame")
        self._by, self._l0, self._linf, self._public = by, max_groups_contributed, max_contributions_per_group, public_keys
        return self

    def _add(self, metric: Metric, name: str | None, column: str | None = None, low: float | None = None, high: float | None = None) -> "QueryBuilder":
        require(column is None or column in self._df.columns, f"Column {column} is not present in DataFrame")
        self._wanted.append(_Wanted(metric, name or metric.column, column, low, high))
        return self

    def count(self, name: str | None = None) -> "QueryBuilder":
        return self._add(Metrics.COUNT, name)

    def privacy_id_count(self, name: str | None = None) -> "QueryBuilder":
        return self._add(Metrics.PRIVACY_ID_COUNT, name)

    def sum(self, column: str, *, min_value: float | None = None, max_value: float | None = None, name: str | None = None) -> "QueryBuilder":
        return self._add(Metrics.SUM, name, column, min_value, max_value)

    def mean(self, column: str, *, min_value: float | None = None, max_value: float | None = None, name: str | None = None) -> "QueryBuilder":
        return self._add(Metrics.MEAN, name, column, min_value, max_value)

    def variance(self, column: str, *, min_value: float | None = None, max_value: float | None = None, name: str | None = None) -> "QueryBuilder":
        return self._add(Metrics.VARIANCE, name, column, min_value, max_value)

    def percentile(self, column: str, percentile: float, *, min_value: float | None = None, max_value: float | None = None, name: str | None = None) -> "QueryBuilder":
        return self._add(Metrics.PERCENTILE(percentile), name, column, min_value, max_value)

    def vector_sum(self, column: str, *, size: int, max_norm: float, norm: NormKind = NormKind.Linf, name: str | None = None) -> "QueryBuilder":
        self._vector = {"vector_size": size, "vector_max_norm": max_norm, "vector_norm_kind": norm}
        return self._add(Metrics.VECTOR_SUM, name, column)

    def build_query(self) -> Query:
        if self._by is None:
            raise NotImplementedError("Global aggregations are not implemented yet: call groupby.")
        require(bool(self._wanted), "No aggregations in the query.")
        metrics = [w.metric for w in self._wanted]
        require(len(set(metrics)) == len(metrics), f"Each aggregation can be added only once, but there are {metrics}.")
        over = [w for w in self._wanted if w.column is not None]
        require(len({w.column for w in over}) <= 1, "Aggregations of several columns are not supported.")
        capped = [w for w in over if w.metric != Metrics.VECTOR_SUM]
        caps = {(w.low, w.high) for w in capped if w.low is not None or w.high is not None}
        require(not capped or bool(caps), "min_value and max_value must be given for an aggregation of a column.")
        require(len(caps) <= 1, f"All aggregations of a column must have the same min_value and max_value, but there are {caps}.")
        low, high = next(iter(caps), (None, None))
        require((low is None) == (high is None), "min_value and max_value must be given both.")
        by = self._by[0] if len(self._by) == 1 else self._by
        return Query(self._df, Columns(self._privacy, by, over[0].column if over else None), ContributionBounds(self._l0, self._linf, low, high), {w.metric: w.name for w in self._wanted}, self._public, self._vector)
