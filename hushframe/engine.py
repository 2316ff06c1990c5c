"""The DP engine: plans aggregations as DataFrames, releases them once the budget is known."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import mechanisms as m
from .budget import BudgetAccountant, NaiveBudgetAccountant
from .extractors import DataExtractors, extract, key_names
from .params import (
    AddDPNoiseParams, AggregateParams, CalculatePrivateContributionBoundsParams, Metrics, PartitionSelectionStrategy, PrivateContributionBounds, SelectPartitionsParams, check_positive_int, require,
)
from .operators.quantiles import leaf as quantile_leaf
from .operators.quantiles import merge_trees, pack_trees
from .plans.bounding import Sampling, bound, sample
from .plans.columnar import as_columnar, fields, merged_states
from .plans.metrics import grouped_rows, plan_metrics, single_rows
from .report import ExplainComputationReport, ReportGenerator, annotate
from .selection import create_partition_selector

#: Public keys given as a list up to which they are broadcast.
BROADCAST_KEYS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a local session gets a
    folder of its own, and on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/release-{uuid.uuid4().hex}"
    if getattr(_folders, "paths", None) is not None:
        _folders.paths.append(path)
    return path


_folders = threading.local()


@contextmanager
def released_folders(spark: SparkSession) -> Iterator[None]:
    """At its end, deletes the folders that releases of this thread made since its begin:
    what is read from them must be written elsewhere by then."""
    before, _folders.paths = getattr(_folders, "paths", None), []
    try:
        yield
    finally:
        for path in _folders.paths:
            delete_folder(spark, path)
        _folders.paths = before


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class DPResult:
    """A planned release.  ``to_df()`` draws the noise, once: it writes the released rows
    to the shared folder, and every later use reads those.  ``close()``, or leaving a
    ``with`` block, deletes them: afterwards nothing can be read, and nothing drawn again."""

    def __init__(self, build: Callable[[], DataFrame], ready: Callable[[], bool]):
        self._build, self._ready, self._df, self._path, self._closed = build, ready, None, None, False

    def to_df(self) -> DataFrame:
        if self._closed:
            raise ValueError("this release was closed")
        if self._df is None:
            if not self._ready():
                raise AssertionError("a release needs its budget: call compute_budgets() first")
            planned = self._build()
            spark = planned.sparkSession
            self._path = shared_folder(spark)
            planned.write.parquet(self._path)
            self._df = spark.read.schema(planned.schema).parquet(self._path)
        return self._df

    def close(self) -> None:
        self._closed = True
        if self._df is not None:
            delete_folder(self._df.sparkSession, self._path)
            self._df = None

    def __enter__(self) -> "DPResult":
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def collect(self) -> list[T.Row]:
        return self.to_df().collect()


class CustomCombiner:
    """A user-defined aggregate, a unit's values at a time.  Accumulators are any picklable
    objects.  ``plans.columnar.ColumnarCombiner`` is the protocol of whole columns."""

    def request_budget(self, accountant: BudgetAccountant) -> None:
        raise NotImplementedError

    def create_accumulator(self, values: list[Any]) -> Any:
        raise NotImplementedError

    def merge_accumulators(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def compute_metrics(self, accumulator: Any) -> dict[str, float]:
        raise NotImplementedError

    def metrics_names(self) -> list[str]:
        raise NotImplementedError

    def output_schema(self) -> str:
        """The results' columns, as DDL: doubles, unless another one is stated here."""
        return ", ".join(f"`{n}` double" for n in self.metrics_names())

    def explain_computation(self) -> str:
        return f"Computed custom metrics {self.metrics_names()}"

    def set_aggregate_params(self, params: AggregateParams) -> None:
        self._aggregate_params = params


def public_frame(spark: SparkSession, public: DataFrame | Iterable[Any], keys: list[str], like: T.StructType) -> DataFrame:
    """Distinct public keys as columns ``keys``; a short list is broadcast in joins."""
    if isinstance(public, DataFrame):
        return public.toDF(*keys).select(*[F.col(k).cast(like[k].dataType).alias(k) for k in keys]).distinct()
    rows = [p if isinstance(p, tuple) else (p,) for p in public]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField(k, like[k].dataType) for k in keys])).distinct()
    return F.broadcast(frame) if len(rows) <= BROADCAST_KEYS else frame


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality: a null key is a key."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


class DPEngine:
    """Performs DP aggregations on DataFrames under one budget accountant."""

    def __init__(self, budget_accountant: BudgetAccountant, sampling: Sampling = Sampling()):
        self._accountant, self._sampling = budget_accountant, sampling
        self._reports: list[ReportGenerator] = []

    def explain_computations_report(self) -> list[str]:
        return [r.report() for r in self._reports]

    def _report(self, params: Any, method: str, public: bool | None, out: ExplainComputationReport | None) -> ReportGenerator:
        generator = ReportGenerator(params, method, public)
        self._reports.append(generator)
        if out is not None:
            out._set_report_generator(generator)
        return generator

    def _ready(self) -> bool:
        return self._accountant._finalized

    # aggregate

    def aggregate(self, col: DataFrame, params: AggregateParams, data_extractors: DataExtractors, public_partitions: DataFrame | Iterable[Any] | None = None, out_explain_computation_report: ExplainComputationReport | None = None) -> DPResult:
        """DP metrics by partition key: key columns and a column for each metric."""
        self._check_aggregate(col, params, data_extractors)
        with self._accountant.scope(weight=params.budget_weight):
            report = self._report(params, "aggregate", public_partitions is not None, out_explain_computation_report)
            if public_partitions is not None and not isinstance(public_partitions, DataFrame):
                public_partitions = list(public_partitions)
            result = self._custom(col, params, data_extractors, public_partitions, report) if params.custom_combiners else self._standard(col, params, data_extractors, public_partitions, report)
            budget = self._accountant._compute_budget_for_aggregation(params.budget_weight)
            return self._annotated(result, params, budget)

    def _annotated(self, build: Callable[[], DataFrame], params: Any, budget: Any) -> DPResult:
        return DPResult(lambda: annotate(build(), params=params, budget=budget), self._ready)

    def _rows(self, col: DataFrame, e: DataExtractors, p: AggregateParams, public: Any, report: ReportGenerator) -> tuple[DataFrame, list[str], list[str], DataFrame | None]:
        rows, names = extract(col, e, self._sampling.row_id)
        keys = [f"k{i}" for i in range(len(names))]
        listed = None
        if public is not None:
            listed = public_frame(col.sparkSession, public, keys, rows.schema)
            if not p.public_partitions_already_filtered:
                rows = rows.join(listed, same_keys(rows, listed, keys), "left_semi")
                report.add_stage("Public partition selection: dropped non public partitions")
        return rows, keys, names, listed

    @staticmethod
    def _few_keys(p: AggregateParams, public: Any) -> bool:
        """Whether the listed public keys, to which rows were cut down, are no more than a unit
        may have.  Keys in a frame aren't counted."""
        return isinstance(public, list) and not p.public_partitions_already_filtered and p.max_partitions_contributed is not None and len(public) <= p.max_partitions_contributed

    def _needs_value(self, p: AggregateParams) -> bool:
        return any(x in (Metrics.SUM, Metrics.MEAN, Metrics.VARIANCE, Metrics.VECTOR_SUM) or x.is_percentile for x in p.metrics or ())

    def _standard(self, col: DataFrame, p: AggregateParams, e: DataExtractors, public: Any, report: ReportGenerator) -> Callable[[], DataFrame]:
        plans = plan_metrics(p, self._accountant)
        rows, keys, names, listed = self._rows(col, e, p, public, report)
        if self._needs_value(p):  # a row without a value contributes nothing
            rows = rows.where(F.col("value").isNotNull() & (~F.isnan("value") if rows.schema["value"].dataType.typeName() == "double" else F.lit(True)))
        counted = not p.contribution_bounds_already_enforced and p.max_contributions is None and bool(p.metrics) and set(p.metrics) <= {Metrics.COUNT, Metrics.PRIVACY_ID_COUNT}
        fold = single_rows() if p.contribution_bounds_already_enforced else grouped_rows(p.max_contributions_per_partition if counted else None)
        partials = {k: c for plan in plans for k, c in plan.partials(fold).items()}
        if p.contribution_bounds_already_enforced:  # every row is a contribution of its own
            unit = rows.select(*keys, *[c.alias(k) for k, c in partials.items()])
            divide = p.max_contributions or p.max_contributions_per_partition
        else:
            unit, stages = bound(rows, keys, p, [c.alias(k) for k, c in partials.items()] or [F.lit(1).alias("_one")], any(x.sampled for x in plans), self._sampling, counted, self._few_keys(p, public))
            for s in stages:
                report.add_stage(s)
            divide = 1
        columnar = [plan.columnar for plan in plans if plan.columnar is not None]
        merged = None
        if columnar:  # vectors: summed as arrays, in one column whatever their size
            states, _ = merged_states(unit, keys, columnar, "_vectors")
            merged = states.withColumnRenamed("s0_vector", "_vector")
        if merged is None or len(plans) > len(columnar):
            sums = unit.groupBy(*keys).agg(F.count("*").alias("_units"), *[c.alias(k) for plan in plans for k, c in plan.merged.items()])
            merged = sums if merged is None else self._beside(sums, merged.drop("_units"), keys)
        if "_leaves" in partials:
            leaves = unit.select(*keys, F.explode("_leaves").alias("leaf")).groupBy(*keys, "leaf").agg(F.count("*").alias("n"))
            merged = self._beside(merged, pack_trees(leaves, keys, p.min_value, p.max_value).withColumnRenamed("tree", "_tree"), keys)
        if listed is not None:
            merged = self._with_public(merged, listed, keys, plans)
        private = public is None and not p.post_aggregation_thresholding and not p.public_partitions_already_filtered
        keep = self._selection(p, divide, report) if private else None
        for plan in plans:
            report.add_stage(plan.explain)
        drop = Metrics.PRIVACY_ID_COUNT.column if p.post_aggregation_thresholding else None
        return lambda: release(merged, keys, names, plans, keep() if keep else None, drop)

    def _beside(self, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        """The columns of ``b`` beside those of ``a``, by key; both have a row for each key."""
        return a.alias("a").join(b.alias("b"), self._on(keys), "left").select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in keys])

    @staticmethod
    def _on(keys: list[str]) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        return out

    def _with_public(self, merged: DataFrame, listed: DataFrame, keys: list[str], plans: list[Any]) -> DataFrame:
        """All public keys; those without data get empty sums."""
        filled = listed.alias("a").join(merged.alias("b"), self._on(keys), "left")
        numbers = [c for c in merged.columns if c not in keys]
        fill = [F.coalesce(F.col(f"b.{c}"), F.lit(0).cast(merged.schema[c].dataType)).alias(c) if merged.schema[c].dataType.typeName() in ("double", "long", "bigint", "integer") else F.col(f"b.{c}").alias(c) for c in numbers]
        return filled.select(*[F.col(f"a.{k}").alias(k) for k in keys], *fill)

    def _selection(self, p: AggregateParams, divide: int, report: ReportGenerator) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
        strategy, l0, pre = p.partition_selection_strategy, p.max_partitions_contributed or p.max_contributions, p.pre_threshold
        spec = self._accountant.request_budget(strategy.mechanism_type, name="PartitionSelection")

        def told() -> str:
            what = f"noise_stddev={spec.noise_standard_deviation}, thresholding_delta={spec.thresholding_delta}" if spec.standard_deviation_is_set and strategy.mechanism_type.is_thresholding_mechanism else f"eps={spec.eps}, delta={spec.delta}"
            return f"Private Partition selection: using {strategy.value} method with ({what}{f', pre_threshold={pre}' if pre else ''})"

        report.add_stage(told)

        def make() -> Callable[[np.ndarray], np.ndarray]:
            selector = create_partition_selector(strategy, spec, l0, pre)
            # weights of weighted selection are no whole numbers
            return lambda units: selector.keep(units if divide == 1 else -(-units // divide))

        return make

    def _custom(self, col: DataFrame, p: AggregateParams, e: DataExtractors, public: Any, report: ReportGenerator) -> Callable[[], DataFrame]:
        combiners = [as_columnar(c) for c in p.custom_combiners]
        for c in combiners:
            c.set_aggregate_params(p)
            c.request_budget(self._accountant)
        rows, keys, names, listed = self._rows(col, e, p, public, report)
        if p.contribution_bounds_already_enforced:
            unit = rows.select(*keys, F.filter(F.array("value"), lambda v: v.isNotNull()).alias("values"))
        else:
            unit, stages = bound(rows, keys, p, [F.collect_list("value").alias("values")], True, self._sampling)
            for s in stages:
                report.add_stage(s)
        divide = (p.max_contributions or p.max_contributions_per_partition) if p.contribution_bounds_already_enforced else 1
        keep = self._selection(p, divide, report) if public is None and not p.public_partitions_already_filtered else None
        for c in combiners:
            report.add_stage(c.explain_computation())
        outputs = [f for c in combiners for f in fields(c.output_schema())]
        merged, table = merged_states(unit, keys, combiners, "values")
        if listed is not None:
            own = [c for c in merged.columns if c not in keys and c != "_units"]
            merged = listed.alias("a").join(merged.alias("b"), self._on(keys), "left").select(*[F.col(f"a.{k}").alias(k) for k in keys], F.coalesce("b._units", F.lit(0)).alias("_units"), *[F.col(f"b.{c}").alias(c) for c in own])
        schema = T.StructType([*[merged.schema[k] for k in keys], *outputs])
        arrow = to_arrow_schema(schema)

        def build() -> DataFrame:
            chosen = keep() if keep else None

            def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    units = batch.column("_units").to_numpy()
                    if chosen is not None and batch.num_rows:
                        batch = batch.filter(pa.array(chosen(units)))
                        units = batch.column("_units").to_numpy()
                    if not batch.num_rows:
                        continue
                    # public keys without data have empty states
                    absent = units == 0
                    place = np.empty(len(units), np.int64)
                    place[np.append(np.flatnonzero(~absent), np.flatnonzero(absent))] = np.arange(len(units))
                    held, empty = batch.filter(pa.array(~absent)), table.empty(int(absent.sum()))
                    found: dict[str, Any] = {}
                    for i, c in enumerate(combiners):
                        states = table.states(held, i)
                        found |= c.compute_metrics({k: pa.concat_arrays([v, empty[i][k].cast(v.type)]).take(pa.array(place)) for k, v in states.items()})
                    columns = [found[f.name] if isinstance(found[f.name], pa.Array) else pa.array(found[f.name], arrow.field(f.name).type, from_pandas=True) for f in outputs]
                    yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *columns], schema=arrow)

            return merged.mapInArrow(compute, schema).toDF(*names, *[f.name for f in outputs])

        return build

    # several levels of keys

    def aggregate_levels(self, col: DataFrame, params: AggregateParams, data_extractors: DataExtractors, levels: Sequence[Sequence[str]], public_partitions: DataFrame | Iterable[Any] | None = None) -> DPResult:
        """DP metrics by several sets of the partition key's columns, out of one bounded pass:
        key columns (null where a level leaves them out), ``level`` (its place in ``levels``)
        and a column for each metric.

        Contributions are bounded once, by whole keys.  A unit's rows may all meet in one
        partition of a coarser level, so noise there allows for ``max_partitions_contributed *
        max_contributions_per_partition`` of them.  The levels share the budget evenly;
        ``public_partitions`` are whole keys, and coarser levels publish what they contain."""
        self._check_aggregate(col, params, data_extractors)
        names = key_names(data_extractors.partition_extractor)
        keys = [f"k{i}" for i in range(len(names))]
        levels = [list(level) for level in levels]
        require(bool(levels) and all(set(level) <= set(names) for level in levels), f"levels are sets of the key's columns {names}")
        require(len({frozenset(level) for level in levels}) == len(levels), "a level is given twice")
        allowed = {Metrics.COUNT, Metrics.SUM, Metrics.MEAN, Metrics.PRIVACY_ID_COUNT}
        require(bool(params.metrics) and set(params.metrics) <= allowed, "levels have COUNT, SUM, MEAN and PRIVACY_ID_COUNT")
        require(not (params.max_contributions or params.post_aggregation_thresholding or params.contribution_bounds_already_enforced or params.bounds_per_partition_are_set), "levels are bounded by max_partitions_contributed and max_contributions_per_partition, and by values")
        with self._accountant.scope(weight=params.budget_weight):
            report = self._report(params, "aggregate_levels", public_partitions is not None, None)
            # no level's partials differ: all sum what bounding by whole keys left
            plans = [self._level_plans(params, set(level) == set(names)) for level in levels]
            keeps = [self._selection(params, 1, report) for _ in levels] if public_partitions is None else [None] * len(levels)
            rows, keys, names, listed = self._rows(col, data_extractors, params, public_partitions, report)
            if self._needs_value(params):
                rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
            fold = grouped_rows()
            partials = {k: c for plan in plans[0] for k, c in plan.partials(fold).items() if k != "_privacy_id_count"}
            unit, stages = bound(rows, keys, params, [c.alias(k) for k, c in partials.items()] or [F.lit(1).alias("_one")], any(x.sampled for x in plans[0]), self._sampling)
            for s in stages:
                report.add_stage(s)
            of = dict(zip(names, keys))
            sets = [["pid", *[of[n] for n in level]] for level in levels]
            # one row for each unit in each partition of each level
            by_level = unit.groupingSets([[F.col(c) for c in s] for s in sets], "pid", *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_gid"), *[F.sum(k).alias(k) for k in partials])
            number = F.create_map(*[F.lit(x) for i, s in enumerate(sets) for x in (sum(1 << j for j, k in enumerate(reversed(keys)) if k not in s), i)])
            by_level = by_level.withColumn("_level", number[F.col("_gid").cast("int")])
            merged = by_level.groupBy("_level", *keys).agg(F.count("*").alias("_units"), *[F.sum(k).alias(k) for k in partials], F.count("*").cast("double").alias("_privacy_id_count"))
            if listed is not None:
                wanted = listed.groupingSets([[F.col(c) for c in s[1:]] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_gid")).withColumn("_level", number[F.col("_gid").cast("int")]).select("_level", *keys)
                merged = self._with_public(merged, wanted, ["_level", *keys], plans[0])
            for own in plans:
                for plan in own:
                    report.add_stage(plan.explain)
            budget = self._accountant._compute_budget_for_aggregation(params.budget_weight)
            return self._annotated(lambda: release_levels(merged, keys, names, plans, [k() if k else None for k in keeps]), params, budget)

    def _level_plans(self, p: AggregateParams, finest: bool) -> list[Any]:
        if finest:
            return plan_metrics(p, self._accountant)
        total = p.max_partitions_contributed * p.max_contributions_per_partition
        values = [x for x in p.metrics if x != Metrics.PRIVACY_ID_COUNT]
        coarse = replace(p, metrics=values, max_partitions_contributed=None, max_contributions_per_partition=None, max_contributions=total)
        plans = plan_metrics(coarse, self._accountant) if values else []
        if Metrics.PRIVACY_ID_COUNT in p.metrics:
            plans += plan_metrics(replace(p, metrics=[Metrics.PRIVACY_ID_COUNT]), self._accountant)
        return plans

    # percentiles from stored trees

    def percentile_states(self, col: DataFrame, params: AggregateParams, data_extractors: DataExtractors) -> DataFrame:
        """(key columns, units, tree): the quantile tree of each partition after contribution
        bounding, with the number of its privacy units.  These rows are not protected: keep
        them where the raw data lies.  They merge with those of other tables, and
        ``release_percentiles`` protects what is published of them."""
        self._check_percentiles(params)
        _check_frame(col)
        rows, keys, names, _ = self._rows(col, data_extractors, params, None, ReportGenerator(params, "percentile_states", False))
        rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
        leaves = quantile_leaf(F.col("value"), params.min_value, params.max_value)
        unit, _ = bound(rows, keys, params, [F.collect_list(leaves).alias("_leaves")], True, self._sampling)
        units = unit.groupBy(*keys).agg(F.count("*").alias("units"))
        counted = unit.select(*keys, F.explode("_leaves").alias("leaf")).groupBy(*keys, "leaf").agg(F.count("*").alias("n"))
        return self._beside(units, pack_trees(counted, keys, params.min_value, params.max_value), keys).toDF(*names, "units", "tree")

    def release_percentiles(self, states: DataFrame, params: AggregateParams, public_partitions: DataFrame | Iterable[Any] | None = None, tables_per_unit: int = 1) -> DPResult:
        """DP percentiles of the merged ``states`` of any number of tables.  ``tables_per_unit``:
        tables in which one privacy unit may have rows (1 where their units differ); each
        has bounded it on its own, so noise and selection allow for that many times as much."""
        self._check_percentiles(params)
        check_positive_int(tables_per_unit, "tables_per_unit")
        names = [c for c in states.columns if c not in ("units", "tree")]
        keys = [f"k{i}" for i in range(len(names))]
        with self._accountant.scope(weight=params.budget_weight):
            report = self._report(params, "release_percentiles", public_partitions is not None, None)
            p = params
            if tables_per_unit > 1:
                own = "max_contributions" if params.max_contributions else "max_contributions_per_partition"
                p = replace(params, **{own: getattr(params, own) * tables_per_unit})
            plans = plan_metrics(p, self._accountant)
            flat = states.toDF(*keys, "units", "tree") if list(states.columns) == [*names, "units", "tree"] else states.select(*[states[n].alias(k) for n, k in zip(names, keys)], "units", "tree")
            listed = None
            if public_partitions is not None:
                listed = public_frame(states.sparkSession, public_partitions, keys, flat.schema)
                flat = flat.join(listed, same_keys(flat, listed, keys), "left_semi")
            units = flat.groupBy(*keys).agg(F.sum("units").alias("_units"))
            merged = self._beside(units, merge_trees(flat, keys, p.min_value, p.max_value).withColumnRenamed("tree", "_tree"), keys)
            if listed is not None:
                merged = self._with_public(merged, listed, keys, plans)
            keep = self._selection(params, tables_per_unit, report) if listed is None else None
            for plan in plans:
                report.add_stage(plan.explain)
            budget = self._accountant._compute_budget_for_aggregation(params.budget_weight)
            return self._annotated(lambda: release(merged, keys, names, plans, keep() if keep else None, None), params, budget)

    def _check_percentiles(self, p: AggregateParams) -> None:
        require(isinstance(p, AggregateParams) and bool(p.metrics) and all(x.is_percentile for x in p.metrics), "trees hold percentiles only: every metric must be a PERCENTILE")
        require(p.min_value is not None and p.max_value is not None, "percentiles need min_value and max_value")

    # partition selection

    def select_partitions(self, col: DataFrame, params: SelectPartitionsParams, data_extractors: DataExtractors) -> DPResult:
        """The partition keys that may be published."""
        _check_frame(col)
        require(isinstance(params, SelectPartitionsParams), "params must be SelectPartitionsParams")
        check_positive_int(params.max_partitions_contributed, "max_partitions_contributed")
        with self._accountant.scope(weight=params.budget_weight):
            report = self._report(params, "select_partitions", False, None)
            strategy = params.partition_selection_strategy
            rows, names = extract(col, data_extractors)
            keys = [f"k{i}" for i in range(len(names))]
            units = rows.select("pid", *keys) if params.contribution_bounds_already_enforced else sample(rows.select("pid", *keys).distinct(), ["pid"], params.max_partitions_contributed, self._sampling.of_keys(keys))
            if not params.contribution_bounds_already_enforced:
                report.add_stage(f"Cross-partition contribution bounding: a random sample of at most {params.max_partitions_contributed} partitions of each privacy id")
            if strategy is PartitionSelectionStrategy.WEIGHTED_GAUSSIAN_THRESHOLDING:
                from pyspark.sql import Window

                units = units.withColumn("_w", 1 / F.sqrt(F.count("*").over(Window.partitionBy("pid"))))
                merged = units.groupBy(*keys).agg(F.sum("_w").alias("_units"))
            else:
                merged = units.groupBy(*keys).agg(F.count("*").alias("_units"))
            as_params = AggregateParams(metrics=[], max_partitions_contributed=params.max_partitions_contributed, max_contributions_per_partition=1, partition_selection_strategy=strategy, pre_threshold=params.pre_threshold)
            keep = self._selection(as_params, 1, report)
            budget = self._accountant._compute_budget_for_aggregation(params.budget_weight)
            return self._annotated(lambda: release(merged, keys, names, [], keep(), None), params, budget)

    # noise on aggregated data

    def add_dp_noise(self, col: DataFrame, params: AddDPNoiseParams, value: str = "value") -> DPResult:
        """``col`` with noise added to the number or array ``value``; nothing is bounded.  With
        ``output_noise_stddev`` a column noise_stddev follows."""
        _check_frame(col)
        sensitivities = m.Sensitivities(params.l0_sensitivity, params.linf_sensitivity, params.l1_sensitivity, params.l2_sensitivity)
        with self._accountant.scope(weight=params.budget_weight):
            report = self._report(params, "add_dp_noise", None, None)
            spec = self._accountant.request_budget(params.noise_kind.convert_to_mechanism_type(), weight=params.budget_weight)
            report.add_stage(lambda: f"Adding {params.noise_kind} noise with parameters {m.create_additive_mechanism(spec, sensitivities).describe()}")
            budget = self._accountant._compute_budget_for_aggregation(params.budget_weight)
        array = col.schema[value].dataType.typeName() == "array"
        cast = col.withColumn(value, F.col(value).cast("array<double>" if array else "double"))
        schema = T.StructType(cast.schema.fields + ([T.StructField("noise_stddev", T.DoubleType(), False)] if params.output_noise_stddev else []))

        def build() -> DataFrame:
            mechanism = m.create_additive_mechanism(spec, sensitivities)

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for df in batches:
                    df = df.copy()
                    df[value] = [mechanism.add_noise(v) for v in df[value]] if array else mechanism.add_noise(df[value].to_numpy(float))
                    if params.output_noise_stddev:
                        df["noise_stddev"] = mechanism.std
                    yield df

            return cast.mapInPandas(run, schema)

        return self._annotated(build, params, budget)

    # private contribution bounds

    def calculate_private_contribution_bounds(self, col: DataFrame, params: CalculatePrivateContributionBoundsParams, data_extractors: DataExtractors, partitions: DataFrame | Sequence[Any], partitions_already_filtered: bool = False) -> PrivateContributionBounds:
        """A bound on partitions a unit, chosen by the exponential mechanism."""
        from .operators.contribution_bounds import choose_l0

        _check_frame(col)
        rows, names = extract(col, data_extractors)
        keys = [f"k{i}" for i in range(len(names))]
        listed = public_frame(col.sparkSession, partitions, keys, rows.schema)
        if not partitions_already_filtered:
            rows = rows.join(listed, same_keys(rows, listed, keys), "left_semi")
        return PrivateContributionBounds(choose_l0(rows.select("pid", *keys), keys, listed.count(), params))

    # checks

    def _check_aggregate(self, col: DataFrame, p: AggregateParams, e: DataExtractors) -> None:
        _check_frame(col)
        if p is None:
            raise ValueError("params: AggregateParams are needed")
        if not isinstance(p, AggregateParams):
            raise TypeError("params: AggregateParams are needed")
        if e is None:
            raise ValueError("data_extractors: DataExtractors are needed")
        if not isinstance(e, DataExtractors):
            raise TypeError("data_extractors: DataExtractors are needed")
        if p.contribution_bounds_already_enforced:
            require(e.privacy_id_extractor is None, "a privacy id is needed exactly where bounds are to be enforced")
        else:
            require(e.privacy_id_extractor is not None, "a privacy id is needed exactly where bounds are to be enforced")
        plain = {Metrics.PRIVACY_ID_COUNT, Metrics.COUNT, Metrics.SUM, Metrics.MEAN}
        if p.max_contributions:
            extra = set(p.metrics or ()) - plain
            if extra:
                raise NotImplementedError(f"max_contributions is not supported for {extra}")
        if p.post_aggregation_thresholding:
            require(Metrics.PRIVACY_ID_COUNT in (p.metrics or ()), "post_aggregation_thresholding drops by PRIVACY_ID_COUNT, which isn't asked for")
        if not isinstance(self._accountant, NaiveBudgetAccountant):
            if p.custom_combiners:
                raise NotImplementedError(f"PLD budget accounting is not compatible with custom combiners: {p.custom_combiners}")


def _check_frame(col: Any) -> None:
    if not isinstance(col, DataFrame):
        raise TypeError("col must be a DataFrame")


def _released(batch: pa.RecordBatch, keys: list[str], steps: list[Callable[[pd.DataFrame], dict[str, Any]]], arrow: dict[str, pa.DataType], keep: Callable[[np.ndarray], np.ndarray] | None) -> pa.RecordBatch | None:
    """Keys and noisy results of a batch's partitions that ``keep`` selects."""
    if keep is not None and batch.num_rows:
        batch = batch.filter(pa.array(keep(batch.column("_units").to_numpy())))
    if not batch.num_rows:
        return None
    # keys stay as they are; only the merged sums are unpacked
    df = batch.select([c for c in batch.schema.names if c not in keys]).to_pandas(maps_as_pydicts="strict")
    found = {name: column for step in steps for name, column in step(df).items()}
    columns = [batch.column(k) for k in keys] + [pa.array(found[o], t, from_pandas=True) for o, t in arrow.items()]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, *arrow])


_KINDS = {"double": (T.DoubleType(), pa.float64()), "array<double>": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))}


def release(merged: DataFrame, keys: list[str], names: list[str], plans: list[Any], keep: Callable[[np.ndarray], np.ndarray] | None, drop: str | None) -> DataFrame:
    """Select partitions and add noise in one pass over the merged columns.  Closures are
    pickled now, so the budget has to be known."""
    outputs = {n: t for plan in plans for n, t in plan.outputs.items()}
    fields_ = [merged.schema[k] for k in keys] + [T.StructField(n, _KINDS[t][0], True) for n, t in outputs.items()]
    arrow, steps = {n: _KINDS[t][1] for n, t in outputs.items()}, [plan.release for plan in plans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _released(batch, keys, steps, arrow, keep)
            if out is not None:
                yield out.filter(out.column(drop).is_valid()) if drop else out

    return merged.mapInArrow(run, T.StructType(fields_)).toDF(*names, *outputs)


def release_levels(merged: DataFrame, keys: list[str], names: list[str], plans: list[list[Any]], keeps: list[Callable[[np.ndarray], np.ndarray] | None]) -> DataFrame:
    """``release`` of rows of several levels, each by its own plans and selection."""
    outputs = {n: t for plan in plans[0] for n, t in plan.outputs.items()}
    own = ["_level", *keys]
    fields_ = [merged.schema[k] for k in own] + [T.StructField(n, _KINDS[t][0], True) for n, t in outputs.items()]
    arrow, steps = {n: _KINDS[t][1] for n, t in outputs.items()}, [[plan.release for plan in level] for level in plans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = batch.column("_level").to_numpy()
            for i in np.unique(level).tolist():
                out = _released(batch.filter(pa.array(level == i)), own, steps[i], arrow, keeps[i])
                if out is not None:
                    yield out

    return merged.mapInArrow(run, T.StructType(fields_)).toDF("level", *names, *outputs).select(*names, "level", *outputs)
