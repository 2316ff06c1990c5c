"""Metrics as three pieces: partial sums of a unit in a partition, their merge over
units, and the noisy release from the merged columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import mechanisms as m
from ..budget import BudgetAccountant, MechanismSpec, NaiveBudgetAccountant
from ..operators import quantiles
from ..params import AggregateParams, Metric, Metrics, NormKind, noise_to_thresholding
from ..selection import create_thresholding_mechanism
from .columnar import ColumnarCombiner, VectorSum


@dataclass(frozen=True)
class Rows:
    """How the rows of one unit in one partition fold: aggregates of a group, or, where
    every row stands for itself, plain expressions of that row."""

    total: Callable[[Column], Column]
    number: Column
    listed: Callable[[Column], Column]


def grouped_rows(most: int | None = None) -> Rows:
    """``most``: the number of rows at which a group's count is cut off."""
    number = F.count("*") if most is None else F.least(F.count("*"), F.lit(most))
    return Rows(F.sum, number.cast("double"), F.collect_list)


def single_rows() -> Rows:
    return Rows(lambda c: c, F.lit(1.0), F.array)


@dataclass
class MetricPlan:
    """``release`` maps merged columns (a pandas frame) to output columns, in order."""

    partials: Callable[["Rows"], dict[str, Column]]
    merged: dict[str, Column]
    outputs: dict[str, str]
    release: Callable[[pd.DataFrame], dict[str, Any]]
    explain: Callable[[], str]
    sampled: bool = True
    #: Merges lists of ``_vectors`` where no sum of a column can.
    columnar: ColumnarCombiner | None = None


def clip(value: Column, low: float | None, high: float | None) -> Column:
    return value if low is None else F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def _sum(name: str) -> Column:
    return F.sum(name).alias(name)


def _additive(metric: Metric, p: AggregateParams, accountant: BudgetAccountant) -> MetricPlan:
    """COUNT, SUM and PRIVACY_ID_COUNT: one sum, one noise."""
    name = metric.column
    sensitivities = m.compute_sensitivities(metric, p)
    spec = accountant.request_budget(p.noise_kind.convert_to_mechanism_type(), weight=p.budget_weight, name=metric.name)

    def partials(rows: Rows) -> dict[str, Column]:
        if metric == Metrics.COUNT:
            return {f"_{name}": rows.number}
        if metric == Metrics.PRIVACY_ID_COUNT:
            return {f"_{name}": F.lit(1.0)}
        if p.bounds_per_contribution_are_set:
            total = rows.total(clip(F.col("value"), p.min_value, p.max_value))
        else:
            total = clip(rows.total(F.col("value")), p.min_sum_per_partition, p.max_sum_per_partition)
        return {f"_{name}": F.coalesce(total, F.lit(0.0))}

    outputs = {name: "double"} | ({f"{name}_noise_stddev": "double"} if p.output_noise_stddev else {})

    def release(df: pd.DataFrame) -> dict[str, Any]:
        mechanism = m.create_additive_mechanism(spec, sensitivities)
        out = {name: mechanism.add_noise(df[f"_{name}"].to_numpy())}
        return out | ({f"{name}_noise_stddev": np.full(len(df), mechanism.std)} if p.output_noise_stddev else {})

    def explain() -> str:
        return f"Computed DP {name} with\n     {m.create_additive_mechanism(spec, sensitivities).describe()}"

    by_sum = metric == Metrics.SUM and not p.bounds_per_contribution_are_set
    sampled = metric != Metrics.PRIVACY_ID_COUNT and not by_sum
    return MetricPlan(partials, {f"_{name}": _sum(f"_{name}")}, outputs, release, explain, sampled)


def _thresholded_count(p: AggregateParams, accountant: BudgetAccountant) -> MetricPlan:
    """PRIVACY_ID_COUNT whose noisy value also decides which partitions stay."""
    spec = accountant.request_budget(noise_to_thresholding(p.noise_kind), weight=p.budget_weight, name="PRIVACY_ID_COUNT")
    name = Metrics.PRIVACY_ID_COUNT.column
    outputs = {name: "double"} | ({f"{name}_noise_stddev": "double"} if p.output_noise_stddev else {})

    def mechanism() -> Any:
        return create_thresholding_mechanism(spec, p.max_partitions_contributed or p.max_contributions, p.pre_threshold)

    def release(df: pd.DataFrame) -> dict[str, Any]:
        made = mechanism()
        out = {name: np.array([np.nan if v is None else v for v in made.noised(df[f"_{name}"].to_numpy())], float)}
        return out | ({f"{name}_noise_stddev": np.full(len(df), made.mechanism.std)} if p.output_noise_stddev else {})

    return MetricPlan(lambda rows: {f"_{name}": F.lit(1.0)}, {f"_{name}": _sum(f"_{name}")}, outputs, release, lambda: f"Computed DP privacy_id_count with\n     {mechanism().mechanism.describe()}  threshold={mechanism().threshold}", False)


def _centred(p: AggregateParams) -> Column:
    return clip(F.col("value"), p.min_value, p.max_value) - F.lit(float(m.compute_middle(p.min_value, p.max_value)))


def _mean(p: AggregateParams, wanted: list[str], accountant: BudgetAccountant) -> MetricPlan:
    kind = p.noise_kind.convert_to_mechanism_type()
    for_count, for_sum = (accountant.request_budget(kind, weight=p.budget_weight, name=n) for n in ("MeanCount", "MeanSum"))

    def mechanisms() -> tuple[Any, Any]:
        return m.create_additive_mechanism(for_count, m.compute_sensitivities_for_count(p)), (m.create_additive_mechanism(for_sum, m.compute_sensitivities_for_normalized_sum(p)) if p.min_value != p.max_value else None)

    def release(df: pd.DataFrame) -> dict[str, Any]:
        count, total = mechanisms()
        if total is None:
            n = count.add_noise(df["_n"].to_numpy())
            found = {"count": n, "sum": n * p.min_value, "mean": np.full(len(df), float(p.min_value))}
        else:
            found = m.release_mean(df["_n"].to_numpy(), df["_centred"].to_numpy(), m.compute_middle(p.min_value, p.max_value), count, total)
        return {w: found[w] for w in wanted}

    def explain() -> str:
        count, total = mechanisms()
        return f"DP mean computation:\n    a. Computed normalized_count with\n       {count.describe()}\n    b. Computed normalized_sum with\n       {total.describe() if total else 'no noise'}"

    def partials(rows: Rows) -> dict[str, Column]:
        return {"_n": rows.number, "_centred": F.coalesce(rows.total(_centred(p)), F.lit(0.0))}

    return MetricPlan(partials, {k: _sum(k) for k in ("_n", "_centred")}, dict.fromkeys(wanted, "double"), release, explain)


def _several(p: AggregateParams, accountant: BudgetAccountant, parts: int, name: str) -> MechanismSpec:
    """The budget of a release in ``parts``.  The naive accountant gives it one share, which
    the parts split; one that composes privacy losses composes that of each part."""
    composed = not isinstance(accountant, NaiveBudgetAccountant)
    return accountant.request_budget(p.noise_kind.convert_to_mechanism_type(), weight=p.budget_weight, count=parts if composed else 1, name=name)


def _told(spec: MechanismSpec) -> str:
    return f"noise_stddev={spec.noise_standard_deviation} of a unit of sensitivity, for each part" if spec.standard_deviation_is_set else f"eps={spec.eps} delta={spec.delta}"


def _variance(p: AggregateParams, wanted: list[str], accountant: BudgetAccountant) -> MetricPlan:
    needed = m.variance_sensitivities(p)
    spec = _several(p, accountant, len(needed), "Variance")

    def release(df: pd.DataFrame) -> dict[str, Any]:
        parts = [m.create_additive_mechanism(spec, s) for s in needed] if spec.standard_deviation_is_set else m.variance_mechanisms(p, spec.eps, spec.delta)
        found = m.release_variance(df["_n"].to_numpy(), df["_centred"].to_numpy(), df["_squares"].to_numpy(), p, parts)
        return {w: found[w] for w in wanted}

    def partials(rows: Rows) -> dict[str, Column]:
        x = _centred(p)
        return {"_n": rows.number, "_centred": F.coalesce(rows.total(x), F.lit(0.0)), "_squares": F.coalesce(rows.total(x * x), F.lit(0.0))}

    return MetricPlan(partials, {k: _sum(k) for k in ("_n", "_centred", "_squares")}, dict.fromkeys(wanted, "double"), release, lambda: f"Computed variance with ({_told(spec)})")


def _vector_sum(p: AggregateParams, accountant: BudgetAccountant) -> MetricPlan:
    spec = accountant.request_budget(p.noise_kind.convert_to_mechanism_type(), weight=p.budget_weight, name="VECTOR_SUM")
    size, norm, most = p.vector_size, p.vector_norm_kind or NormKind.Linf, float(p.vector_max_norm)

    def bounded(table: np.ndarray) -> np.ndarray:
        if norm is NormKind.Linf:
            return np.clip(table, -most, most)
        length = np.abs(table).sum(axis=1) if norm is NormKind.L1 else np.sqrt((table * table).sum(axis=1))
        return table * np.where(length > most, most / np.maximum(length, most), 1.0)[:, None]

    def release(df: pd.DataFrame) -> dict[str, Any]:
        zero = [0.0] * size
        at = np.array([list(v) if v is not None else zero for v in df["_vector"]], float).reshape(-1, size)
        l0 = p.max_partitions_contributed or p.max_contributions
        # the sensitivity is that of the whole vector, so the whole budget stands against it
        if spec.standard_deviation_is_set:
            whole = m.vector_sensitivity(p.noise_kind, norm, most, size, l0)
            return {"vector_sum": list(m.create_additive_mechanism(spec, m.Sensitivities(l1=whole, l2=whole)).add_noise(at))}
        noise = m.AdditiveVectorNoiseParams(spec.eps, spec.delta, p.vector_max_norm, l0, 1, norm, p.noise_kind)
        return {"vector_sum": list(m.add_noise_vector(at, noise))}

    def explain() -> str:
        return f"Computed vector sum with ({_told(spec)})"

    return MetricPlan(lambda rows: {"_vectors": rows.listed(F.col("value"))}, {}, {"vector_sum": "array<double>"}, release, explain, columnar=VectorSum(size, bounded))


def _percentiles(p: AggregateParams, metrics: list[Metric], accountant: BudgetAccountant) -> MetricPlan:
    spec = _several(p, accountant, quantiles.HEIGHT, "Quantiles")
    ranks = [x.parameter / 100 for x in metrics]
    names = [x.column for x in metrics]

    def release(df: pd.DataFrame) -> dict[str, Any]:
        trees = [quantiles.QuantileTree(p.min_value, p.max_value) if raw is None else quantiles.QuantileTree.from_bytes(raw) for raw in df["_tree"]]
        noise = m.create_additive_mechanism(spec, quantiles.sensitivities(p)) if spec.standard_deviation_is_set else m.additive_mechanism(p.noise_kind, spec.eps / quantiles.HEIGHT, spec.delta / quantiles.HEIGHT, quantiles.sensitivities(p))
        rows = [quantiles.release(tree, ranks, p, noise=noise) for tree in trees]
        table = np.array(rows, float).reshape(-1, len(ranks))
        return {n: table[:, i] for i, n in enumerate(names)}

    def partials(rows: Rows) -> dict[str, Column]:
        return {"_leaves": rows.listed(quantiles.leaf(F.col("value"), p.min_value, p.max_value))}

    return MetricPlan(partials, {}, dict.fromkeys(names, "double"), release, lambda: f"Computed percentiles {[x.parameter for x in metrics]} with ({_told(spec)})")


def plan_metrics(p: AggregateParams, accountant: BudgetAccountant) -> list[MetricPlan]:
    """Variance gives mean, count and sum; mean gives count and sum; else each on its own."""
    wanted = set(p.metrics or ())
    if len(wanted) != len(p.metrics or ()):
        raise ValueError("A metric is given more than once.")
    plans: list[MetricPlan] = []
    scalars = [Metrics.VARIANCE, Metrics.MEAN, Metrics.COUNT, Metrics.SUM]
    names = [x.column for x in scalars if x in wanted]
    if Metrics.VARIANCE in wanted:
        plans.append(_variance(p, names, accountant))
    elif Metrics.MEAN in wanted:
        plans.append(_mean(p, names, accountant))
    else:
        plans += [_additive(x, p, accountant) for x in (Metrics.COUNT, Metrics.SUM) if x in wanted]
    if Metrics.PRIVACY_ID_COUNT in wanted:
        plans.append(_thresholded_count(p, accountant) if p.post_aggregation_thresholding else _additive(Metrics.PRIVACY_ID_COUNT, p, accountant))
    if Metrics.VECTOR_SUM in wanted:
        plans.append(_vector_sum(p, accountant))
    percentiles = [x for x in p.metrics or () if x.is_percentile]
    if percentiles:
        plans.append(_percentiles(p, percentiles, accountant))
    return plans
