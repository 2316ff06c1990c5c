"""Utility analysis: errors of DP aggregations for many parameter settings at once,
without running them.

Pre-aggregated rows meet the settings (a few rows, broadcast); every setting's errors
are sums by (partition, setting), and reports are sums over partitions.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import mechanisms as m
from ..budget import NaiveBudgetAccountant
from ..extractors import DataExtractors, PreAggregateExtractors
from ..params import AggregateParams, MechanismType, Metric, Metrics, NoiseKind, PartitionSelectionStrategy, check_epsilon_delta, require
from ..selection import create_partition_selection_strategy
from .poisson import compute_pmf, compute_pmf_approximation
from .preaggregate import from_preaggregated, preaggregated_rows

#: Fixed value: units of a partition up to which the distribution of kept units is exact.
EXACT_UNITS = 100
#: Lower bounds of the partition-size buckets: 0, 1, then 1, 2 and 5 times 10, 100, ...
BUCKETS = [0, 1, *[d * 10**i for i in range(1, 13) for d in (1, 2, 5)]]


@dataclass
class MultiParameterConfiguration:
    """Settings to analyse: sequences of one length, one entry a setting."""

    max_partitions_contributed: Sequence[int] | None = None
    max_contributions_per_partition: Sequence[int] | None = None
    min_sum_per_partition: Sequence[Any] | None = None
    max_sum_per_partition: Sequence[Any] | None = None
    noise_kind: Sequence[NoiseKind] | None = None
    partition_selection_strategy: Sequence[PartitionSelectionStrategy] | None = None

    def __post_init__(self) -> None:
        sizes = {len(v) for v in vars(self).values() if v}
        require(bool(sizes), "a configuration without any setting")
        require(len(sizes) == 1, "settings have different numbers of values")
        low, high = self.min_sum_per_partition, self.max_sum_per_partition
        require((low is None) == (high is None), "of min_sum_per_partition and max_sum_per_partition one is missing")
        widths = {len(x) for x in [*(low or ()), *(high or ())] if isinstance(x, (list, tuple))}
        require(len(widths) <= 1, "bounds of several sums have different numbers of columns")

    @property
    def size(self) -> int:
        return next(len(v) for v in vars(self).values() if v)

    def get_aggregate_params(self, blueprint: AggregateParams, index: int) -> tuple[AggregateParams, list[tuple[float, float]]]:
        """One setting's parameters, and (min, max) sums for each value column."""
        out = copy.copy(blueprint)
        for name in ("max_partitions_contributed", "max_contributions_per_partition", "noise_kind", "partition_selection_strategy"):
            if getattr(self, name):
                setattr(out, name, getattr(self, name)[index])
        if not self.min_sum_per_partition:
            return out, [(blueprint.min_sum_per_partition, blueprint.max_sum_per_partition)]
        low, high = self.min_sum_per_partition[index], self.max_sum_per_partition[index]
        return out, list(zip(low, high)) if isinstance(low, (list, tuple)) else [(low, high)]


@dataclass
class UtilityAnalysisOptions:
    epsilon: float
    delta: float
    aggregate_params: AggregateParams
    multi_param_configuration: MultiParameterConfiguration | None = None
    partitions_sampling_prob: float = 1
    pre_aggregated_data: bool = False

    def __post_init__(self) -> None:
        check_epsilon_delta(self.epsilon, self.delta, "UtilityAnalysisOptions")
        require(0 < self.partitions_sampling_prob <= 1, f"partitions_sampling_prob={self.partitions_sampling_prob} is no share above 0")

    @property
    def n_configurations(self) -> int:
        return self.multi_param_configuration.size if self.multi_param_configuration else 1

    def settings(self) -> list[tuple[AggregateParams, list[tuple[float, float]]]]:
        p = self.aggregate_params
        if self.multi_param_configuration is None:
            return [(p, [(p.min_sum_per_partition, p.max_sum_per_partition)])]
        return [self.multi_param_configuration.get_aggregate_params(p, i) for i in range(self.n_configurations)]


@dataclass
class MeanVariance:
    mean: float
    var: float


@dataclass
class ContributionBoundingErrors:
    l0: MeanVariance
    linf_min: float
    linf_max: float


@dataclass
class ValueErrors:
    bounding_errors: ContributionBoundingErrors
    mean: float
    variance: float
    rmse: float
    l1: float
    rmse_with_dropped_partitions: float
    l1_with_dropped_partitions: float


@dataclass
class DataDropInfo:
    l0: float
    linf: float
    partition_selection: float


@dataclass
class MetricUtility:
    metric: Metric
    noise_std: float
    noise_kind: NoiseKind
    ratio_data_dropped: DataDropInfo
    absolute_error: ValueErrors
    relative_error: ValueErrors


@dataclass
class PartitionsInfo:
    public_partitions: bool
    num_dataset_partitions: int
    num_non_public_partitions: int | None = None
    num_empty_partitions: int | None = None
    strategy: PartitionSelectionStrategy | None = None
    kept_partitions: MeanVariance | None = None


@dataclass
class UtilityReport:
    configuration_index: int
    partitions_info: PartitionsInfo
    metric_errors: list[MetricUtility] | None = None
    utility_report_histogram: list["UtilityReportBin"] | None = None


@dataclass
class UtilityReportBin:
    partition_size_from: int
    partition_size_to: int
    report: UtilityReport


@dataclass(frozen=True)
class _Analysed:
    """One metric's columns: its name in them, and the value column for sums."""

    metric: Metric
    name: str
    column: int | None = None


class UtilityAnalysis:
    """An analysis of one dataset; its frames are lazy."""

    def __init__(self, df: DataFrame, options: UtilityAnalysisOptions, data_extractors: DataExtractors | PreAggregateExtractors, public_partitions: Any = None):
        p = options.aggregate_params
        extra = set(p.metrics or ()) - {Metrics.COUNT, Metrics.PRIVACY_ID_COUNT, Metrics.SUM}
        if extra:
            raise NotImplementedError(f"unsupported metric in metrics={extra}")
        require(p.custom_combiners is None, "custom combiners can't be analysed")
        require(not p.contribution_bounds_already_enforced, "where bounds are enforced already there is nothing to analyse")
        self.options, self.public = options, public_partitions is not None
        self.settings = options.settings()
        public = None
        if options.pre_aggregated_data:
            rows, self.names = from_preaggregated(df, data_extractors)
        keys = None
        if self.public:
            from ..engine import public_frame
            from ..extractors import columns, key_names

            self.names = key_names(data_extractors.partition_extractor)
            keys = [f"k{i}" for i in range(len(self.names))]
            like = df.select(*[c.alias(k) for k, c in zip(keys, columns(df, data_extractors.partition_extractor))]).schema
            public = public_frame(df.sparkSession, public_partitions, keys, like)
        if not options.pre_aggregated_data:
            rows, self.names = preaggregated_rows(df, data_extractors, public, options.partitions_sampling_prob, p.perform_cross_partition_contribution_bounding)
        self.keys = [f"k{i}" for i in range(len(self.names))]
        self.width = len(self.settings[0][1]) if rows.schema["sum"].dataType.typeName() == "array" else 1
        self.array = rows.schema["sum"].dataType.typeName() == "array"
        self.metrics = []
        if Metrics.SUM in (p.metrics or ()):
            self.metrics += [_Analysed(Metrics.SUM, f"sum{i}", i) for i in range(self.width)]
        self.metrics += [_Analysed(x, x.column) for x in (Metrics.COUNT, Metrics.PRIVACY_ID_COUNT) if x in (p.metrics or ())]
        self._noise()
        if public is not None:
            if options.pre_aggregated_data:
                from ..engine import same_keys

                rows = rows.join(public, same_keys(rows, public, self.keys), "left_semi")
            rows = self._with_empty(rows, public)
        self.rows = rows

    def _noise(self) -> None:
        """Budgets and noise deviations of each setting, in the order of requests."""
        self.noise: list[list[tuple[float, NoiseKind]]] = []
        self.selection: list[tuple[float, float] | None] = []
        for params, sums in self.settings:
            accountant = NaiveBudgetAccountant(self.options.epsilon, self.options.delta)
            chosen = None if self.public else accountant.request_budget(MechanismType.GENERIC)
            specs = [accountant.request_budget(params.noise_kind.convert_to_mechanism_type()) for _ in self.metrics]
            accountant.compute_budgets()
            found = []
            for spec, x in zip(specs, self.metrics):
                if x.metric == Metrics.SUM:
                    low, high = sums[x.column]
                    s = m.Sensitivities(l0=params.max_partitions_contributed, linf=max(abs(low), abs(high)))
                elif x.metric == Metrics.COUNT:
                    s = m.compute_sensitivities_for_count(params)
                else:
                    s = m.compute_sensitivities_for_privacy_id_count(params)
                found.append((m.create_additive_mechanism(spec, s).std, params.noise_kind))
            self.noise.append(found)
            self.selection.append((chosen.eps, chosen.delta) if chosen else None)

    def _with_empty(self, rows: DataFrame, public: DataFrame) -> DataFrame:
        """A row without contributions for each public key, so empty partitions are seen."""
        zero = F.array(*[F.lit(0.0)] * self.width) if self.array else F.lit(0).cast(rows.schema["sum"].dataType)
        empty = public.select(*self.keys, F.lit(0).cast(rows.schema["count"].dataType).alias("count"), zero.alias("sum"), F.lit(0).cast(rows.schema["n_partitions"].dataType).alias("n_partitions"), F.lit(0).cast(rows.schema["n_contributions"].dataType).alias("n_contributions"))
        return rows.unionByName(empty)

    def _settings_frame(self) -> DataFrame:
        rows = []
        for i, (params, sums) in enumerate(self.settings):
            bounds = []
            for x in self.metrics:
                if x.metric == Metrics.SUM:
                    bounds += [float(b) for b in sums[x.column]]
                else:
                    bounds += [0.0, float(params.max_contributions_per_partition) if x.metric == Metrics.COUNT else 1.0]
            rows.append((i, params.max_partitions_contributed, *bounds))
        fields = [T.StructField("config", T.IntegerType()), T.StructField("l0", T.IntegerType())]
        fields += [T.StructField(f"{x.name}_{end}", T.DoubleType()) for x in self.metrics for end in ("low", "high")]
        return F.broadcast(self.rows.sparkSession.createDataFrame(rows, T.StructType(fields)))

    def sums(self) -> DataFrame:
        """Exact sums by (keys, config): for each metric value, errors by clipping, expected
        and squared error by the bound on partitions; units, rows and moments of kept units."""
        wide = self.rows.crossJoin(self._settings_frame())  # settings are few
        wide = wide.withColumn("q", F.when(F.col("n_partitions") > 0, F.least(F.lit(1.0), F.col("l0") / F.col("n_partitions"))).otherwise(F.lit(0.0)))
        q = F.col("q")
        out = [F.sum(F.when(F.col("count") > 0, 1).otherwise(0)).cast("long").alias("units"), F.sum("count").cast("long").alias("row_count")]
        live = F.col("n_partitions") > 0
        out += [F.sum(F.when(live, q)).alias("q1"), F.sum(F.when(live, q * (1 - q))).alias("q2"), F.sum(F.when(live, q * (1 - q) * (1 - 2 * q))).alias("q3")]
        for x in self.metrics:
            value = {Metrics.COUNT: F.col("count").cast("double"), Metrics.PRIVACY_ID_COUNT: F.when(F.col("count") > 0, 1.0).otherwise(0.0)}.get(x.metric)
            if value is None:
                value = (F.get("sum", x.column) if self.array else F.col("sum")).cast("double")
            low, high = F.col(f"{x.name}_low"), F.col(f"{x.name}_high")
            clipped = F.least(F.greatest(value, low), high)
            out += [
                F.sum(value).alias(f"{x.name}_value"), F.sum(F.when(value < low, clipped - value).otherwise(0.0)).alias(f"{x.name}_to_min"),
                F.sum(F.when(value > high, clipped - value).otherwise(0.0)).alias(f"{x.name}_to_max"),
                F.sum(-clipped * (1 - q)).alias(f"{x.name}_l0"), F.sum(clipped * clipped * q * (1 - q)).alias(f"{x.name}_l0_var"),
            ]
        return wide.groupBy(*self.keys, "config").agg(*out)

    def per_partition(self) -> DataFrame:
        """The sums with the probability that the partition is published (1 if public)."""
        sums = self.sums()
        if self.public:
            return sums.withColumn("keep", F.lit(1.0))
        # only partitions of few units send their probabilities, so that lists stay short
        few = self.rows.groupBy(*self.keys).agg(F.count("*").alias("n")).where(f"n <= {EXACT_UNITS}")
        on = F.lit(True)
        for k in self.keys:
            on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        own = self.rows.alias("a").join(few.alias("b"), on, "left_semi").select(*[F.col(f"a.{k}").alias(k) for k in self.keys], "n_partitions")
        lists = own.groupBy(*self.keys).agg(F.collect_list("n_partitions").alias("shares"))
        joined = sums.alias("a").join(lists.alias("b"), on, "left").select("a.*", "b.shares")
        plans = [(s[0], s[1], params.max_partitions_contributed, params.partition_selection_strategy, params.pre_threshold) for s, (params, _) in zip(self.selection, self.settings)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            selectors: dict[int, Any] = {}
            for df in batches:
                keep = []
                for config, units, q1, q2, q3, shares in zip(df["config"], df["units"], df["q1"], df["q2"], df["q3"], df["shares"]):
                    eps, delta, l0, strategy, pre = plans[config]
                    if config not in selectors:
                        selectors[config] = create_partition_selection_strategy(strategy, eps, delta, l0, pre)
                    if shares is not None:
                        pmf = compute_pmf([min(1.0, l0 / n) if n > 0 else 0.0 for n in shares])
                    else:
                        std = math.sqrt(q2)
                        pmf = compute_pmf_approximation(q1, std, q3 / std**3 if std else 0.0, int(units))
                    at = np.arange(pmf.start, pmf.start + len(pmf.probabilities))
                    keep.append(float((pmf.probabilities * selectors[config].probabilities(at)).sum()))
                df = df.drop(columns="shares")
                df["keep"] = keep
                yield df

        return joined.mapInPandas(run, T.StructType(sums.schema.fields + [T.StructField("keep", T.DoubleType())]))

    def _errors(self) -> DataFrame:
        """Per-partition errors with noise, by (keys, config)."""
        out = self.per_partition()
        noise = self.rows.sparkSession.createDataFrame([(i, *[float(std) for std, _ in n]) for i, n in enumerate(self.noise)], T.StructType([T.StructField("config", T.IntegerType()), *[T.StructField(f"{x.name}_noise", T.DoubleType()) for x in self.metrics]]))
        out = out.join(F.broadcast(noise), "config")
        for x in self.metrics:
            n = x.name
            out = out.withColumn(f"{n}_mean", F.col(f"{n}_l0") + F.col(f"{n}_to_min") + F.col(f"{n}_to_max"))
            out = out.withColumn(f"{n}_var", F.col(f"{n}_l0_var") + F.col(f"{n}_noise") * F.col(f"{n}_noise"))
            out = out.withColumn(f"{n}_rmse", F.sqrt(F.col(f"{n}_mean") * F.col(f"{n}_mean") + F.col(f"{n}_var")))
            out = out.withColumn(f"{n}_rmse_all", F.col("keep") * F.col(f"{n}_rmse") + (1 - F.col("keep")) * F.abs(f"{n}_value"))
        return out

    def report_rows(self) -> DataFrame:
        """Sums over partitions by (config, bucket); bucket null stands for all partitions.
        Averages are weighted by the probability to be kept."""
        bucket = F.lit(BUCKETS[0])
        for b in BUCKETS[1:]:
            bucket = F.when(F.col("units") >= b, F.lit(b)).otherwise(bucket)
        rows = self._errors().withColumn("bucket", F.explode(F.array(F.lit(None).cast("long"), bucket.cast("long"))))
        w = F.col("keep")
        out = [F.count("*").alias("partitions"), F.sum(F.when(F.col("row_count") == 0, 1).otherwise(0)).cast("long").alias("empty"), F.sum(w).alias("kept"), F.sum(w * (1 - w)).alias("kept_var")]
        for x in self.metrics:
            n = x.name
            value, linf = F.col(f"{n}_value"), F.col(f"{n}_to_min") - F.col(f"{n}_to_max")
            out += [
                F.sum(value).alias(f"{n}_value"), F.sum(-F.col(f"{n}_l0")).alias(f"{n}_drop_l0"), F.sum(linf).alias(f"{n}_drop_linf"),
                F.sum((value + F.col(f"{n}_l0") - linf) * (1 - w)).alias(f"{n}_drop_selection"),
            ]
            for what in ("l0", "l0_var", "to_min", "to_max", "mean", "var", "rmse", "rmse_all"):
                power = 2 if what.endswith("var") else 1
                ratio = F.when(value == 0, F.lit(0.0)).otherwise(F.col(f"{n}_{what}") / F.pow(value, F.lit(power)))
                out += [F.sum(w * F.col(f"{n}_{what}")).alias(f"{n}_abs_{what}"), F.sum(w * ratio).alias(f"{n}_rel_{what}")]
        return rows.groupBy("config", "bucket").agg(*out)

    def reports(self) -> list[UtilityReport]:
        """One report a setting; only (setting, bucket) sums come to the driver."""
        by_config: dict[int, dict[int | None, UtilityReport]] = {}
        for r in self.report_rows().collect():
            by_config.setdefault(r["config"], {})[r["bucket"]] = self._report(r.asDict())
        out = []
        for config in sorted(by_config):
            whole = by_config[config].pop(None)
            bins = sorted(by_config[config].items())
            upper = dict(zip(BUCKETS, [*BUCKETS[1:], -1]))
            whole.utility_report_histogram = [UtilityReportBin(b, upper[b], r) for b, r in bins]
            out.append(whole)
        return out

    def _report(self, r: dict[str, Any]) -> UtilityReport:
        config = r["config"]
        if self.public:
            info = PartitionsInfo(True, r["partitions"] - r["empty"], 0, r["empty"])
        else:
            info = PartitionsInfo(False, r["partitions"], strategy=self.settings[config][0].partition_selection_strategy, kept_partitions=MeanVariance(r["kept"], r["kept_var"]))
        scale = 1 / r["kept"] if r["kept"] else 0.0

        def errors(n: str, kind: str) -> ValueErrors:
            v = {x: r[f"{n}_{kind}_{x}"] * scale for x in ("l0", "l0_var", "to_min", "to_max", "mean", "var", "rmse", "rmse_all")}
            return ValueErrors(ContributionBoundingErrors(MeanVariance(v["l0"], v["l0_var"]), v["to_min"], v["to_max"]), v["mean"], v["var"], v["rmse"], 0, v["rmse_all"], 0)

        found = []
        for x, (std, kind) in zip(self.metrics, self.noise[config]):
            n, total = x.name, r[f"{x.name}_value"] or 1
            drop = DataDropInfo(r[f"{n}_drop_l0"] / total, r[f"{n}_drop_linf"] / total, r[f"{n}_drop_selection"] / total)
            found.append(MetricUtility(x.metric, std, kind, drop, errors(n, "abs"), errors(n, "rel")))
        return UtilityReport(config, info, found or None)


def perform_utility_analysis(df: DataFrame, options: UtilityAnalysisOptions, data_extractors: DataExtractors | PreAggregateExtractors, public_partitions: DataFrame | Iterable[Any] | None = None) -> tuple[list[UtilityReport], DataFrame]:
    """Reports, one a setting, and the per-partition rows (key columns, config, ...)."""
    analysis = UtilityAnalysis(df, options, data_extractors, public_partitions)
    per_partition = analysis._errors()
    for k, name in zip(analysis.keys, analysis.names):
        per_partition = per_partition.withColumnRenamed(k, name)
    return analysis.reports(), per_partition


__all__ = ["BUCKETS", "MultiParameterConfiguration", "UtilityAnalysis", "UtilityAnalysisOptions", "perform_utility_analysis"]
