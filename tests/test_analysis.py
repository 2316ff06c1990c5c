"""Histograms, estimator, utility analysis and tuning: golden numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe import AggregateParams, CalculatePrivateContributionBoundsParams, DataExtractors, Metrics, NoiseKind, PreAggregateExtractors
from hushframe import mechanisms as m
from hushframe.analysis import (
    DPStrategySelector, MinimizingFunction, MultiParameterConfiguration, ParametersToTune, TuneOptions, UtilityAnalysisOptions, compute_public_partitions_summary, perform_utility_analysis, preaggregate, tune,
)
from hushframe.analysis import poisson
from hushframe.analysis.tuning import bin_maxima, constant_relative_step
from hushframe.operators import error_estimator as ee
from hushframe.operators import histograms as h
from hushframe.operators.contribution_bounds import L0ScoringFunction, generate_possible_contribution_bounds
from hushframe.operators.sampling import ValueSampler, filter_by_key_with_sharding, size
from hushframe.params import PartitionSelectionStrategy

E = DataExtractors("pid", "pk", "value")


def bins(spark, values, made, kind):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return h.collected(made(df, "v"))


def test_integer_bins(spark):
    got = bins(spark, [1, 999, 1000, 1012, 12522], h.integer_histogram, "long")
    assert [(b.lower, b.upper) for b in got] == [(1, 2), (999, 1000), (1000, 1010), (1010, 1020), (12500, 12600)]


def test_log_bins(spark):
    got = bins(spark, [0.0, 1.223, -1.223, 134.223, 2334567.0], h.log_histogram, "double")
    assert [(round(b.lower, 6), round(b.upper, 6)) for b in got] == [(-1.3, -1.2), (0, 0), (1.2, 1.3), (130, 140), (2.3e6, 2.4e6)]


def test_linear_bins(spark):
    got = bins(spark, [1.0, 1.5, -2.5], h.linear_histogram, "double")
    assert [round(b.lower, 4) for b in got] == [-2.5, 1.0, 1.4996] and got[-1].upper == pytest.approx(1.5)
    assert [(b.lower, b.upper, b.count) for b in bins(spark, [3.0, 3.0], h.linear_histogram, "double")] == [(3, 3, 2)]


@pytest.fixture(scope="module")
def estimated(spark):
    data = [(1, i, 1.0) for i in range(10)] + [(2, 0, 2.0)] * 20
    return h.compute_dataset_histograms(spark.createDataFrame(data, "pid long, pk long, value double"), E)


def test_estimator(estimated):
    e = ee.create_estimator_for_count_and_privacy_id_count(estimated, math.sqrt(2) / 2, None, Metrics.COUNT, NoiseKind.LAPLACE)
    assert [e.get_ratio_dropped_l0(x) for x in (0, 1, 2, 3, 9, 10, 20)] == pytest.approx([1, 9 / 11, 8 / 11, 7 / 11, 1 / 11, 0, 0])
    assert [e.get_ratio_dropped_linf(x) for x in (0, 1, 2, 10, 20, 21)] == pytest.approx([1, 19 / 30, 18 / 30, 10 / 30, 0, 0])
    assert [e.estimate_rmse(*x) for x in ((1, 1), (1, 2), (10, 10))] == pytest.approx([3.9565310998335823, 5.683396971098993, 200.01249625055996])
    s = ee.create_estimator_for_sum(estimated, math.sqrt(2) / 2, None, NoiseKind.LAPLACE)
    assert s.estimate_rmse(1, 1) == pytest.approx(5.93769917, rel=0.01)
    with pytest.raises(ValueError):
        ee.create_estimator_for_count_and_privacy_id_count(estimated, 1, None, Metrics.COUNT, NoiseKind.GAUSSIAN)


def test_histograms_of_preaggregated_data(spark, estimated):
    data = [(1, i, 1.0) for i in range(10)] + [(2, 0, 2.0)] * 20
    pre = preaggregate(spark.createDataFrame(data, "pid long, pk long, value double"), E)
    again = h.compute_dataset_histograms_on_preaggregated_data(pre, ["pk"])
    assert again == estimated


@pytest.mark.parametrize("b,sigma", [(1, 1), (0.01, 1), (1, 0.02), (3, 500), (2, 0), (0, 2), (7, 3)])
def test_laplace_plus_gaussian(b, sigma):
    """Against a direct convolution on a fine grid, and repeatable."""
    ranks = [1e-6, 0.001, 0.1, 0.5, 0.77, 0.999]
    got = poisson.compute_sum_laplace_gaussian_quantiles(b, sigma, ranks)
    assert got == poisson.compute_sum_laplace_gaussian_quantiles(b, sigma, ranks, 10)
    if b and sigma:
        # P(X + Y <= x): the normal distribution function, averaged over Laplace quantiles
        u = (np.arange(100_000) + 0.5) / 100_000
        laplace = np.where(u < 0.5, b * np.log(2 * u), -b * np.log(2 * (1 - u)))
        for q, x in zip(ranks[1:], got[1:]):
            z = (x - laplace) / sigma
            assert np.mean([0.5 * math.erfc(-v / math.sqrt(2)) for v in z]) == pytest.approx(q, rel=2e-3)
            assert poisson.laplace_gaussian_cdf(x, b, sigma) == pytest.approx(q, rel=1e-9)
    for q, x in zip(ranks, got):
        assert x == pytest.approx(-poisson.compute_sum_laplace_gaussian_quantiles(b, sigma, [1 - q])[0], rel=1e-9, abs=1e-9 * (b + sigma))
    if not sigma:
        assert got[0] == pytest.approx(b * math.log(2e-6), rel=1e-9)


def test_quantiles():
    hist = h.Histogram(h.HistogramType.L0_CONTRIBUTIONS, [h.FrequencyBin(lower, lower + 1, n, n * lower, lower) for lower, n in ((1, 5), (2, 1), (6, 2), (10, 2))])
    assert hist.quantiles([0.001, 0.5, 0.55, 0.8, 0.9]) == [1, 2, 2, 10, 10]


def test_bounds_grid_and_scores():
    grid = generate_possible_contribution_bounds(999_999)
    assert grid[:3] == [1, 2, 3] and 1010 in grid and 1005 not in grid and 10_100 in grid and grid[-1] == 999_000
    params = CalculatePrivateContributionBoundsParams(NoiseKind.LAPLACE, 0.9, 0, 0.9, 100)
    scoring = L0ScoringFunction(params, 200, [h.FrequencyBin(1, 2, 5, 5, 1), h.FrequencyBin(10, 11, 2, 20, 10)])
    assert scoring.global_sensitivity == 100 and scoring.score(4) == pytest.approx(-100 * 4 / 0.9 * 2**0.5 - 6)


def test_sampler_goldens(spark):
    for p, n, kept in ((0.5, 1000, 481), (0.3, 1000, 298), (0.8, 10000, 8074)):
        sampler = ValueSampler(p)
        assert sum(map(sampler.keep, range(n))) == kept
        assert spark.range(n).where(sampler.condition(F.col("id"))).count() == kept
    text = spark.createDataFrame([("pk1",)], "k string").where(ValueSampler(0.5).condition(F.col("k"), text=True))
    assert ValueSampler(0.5).keep("pk1") == (text.count() == 1)


def test_sharded_filter_and_size(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v int")
    keys = spark.createDataFrame([(0,), (0,), (2,)], "k int")
    assert filter_by_key_with_sharding(df, keys, "k", 5).count() == 20
    assert size(df).first()[0] == 30 and size(df.limit(0)).count() == 0


def test_poisson_binomial():
    r = random.Random(1)
    p = [r.random() for _ in range(300)]
    mean, std, skew = poisson.compute_exp_std_skewness(p)
    exact, near = poisson.compute_pmf(p), poisson.compute_pmf_approximation(mean, std, skew, len(p))
    full = np.zeros(301)
    full[near.start : near.start + len(near.probabilities)] = near.probabilities
    assert np.abs(full - exact.probabilities).max() < 1e-3
    assert len(poisson.compute_sum_laplace_gaussian_quantiles(1, 1, [0.1, 0.5], 1000)) == 2


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(str(i), f"pk{j}", 0.0) for i in range(10) for j in range(10) for _ in range(3)], "pid string, pk string, value double")


def test_cross_grid_report(grid):
    p = AggregateParams(metrics=[Metrics.COUNT, Metrics.PRIVACY_ID_COUNT], noise_kind=NoiseKind.GAUSSIAN, max_partitions_contributed=1, max_contributions_per_partition=2)
    reports, per_partition = perform_utility_analysis(grid, UtilityAnalysisOptions(3, 0.9, p), E)
    (r,) = reports
    assert r.partitions_info.kept_partitions.mean == pytest.approx(3.51622411) and r.partitions_info.kept_partitions.var == pytest.approx(2.2798409)
    count, users = r.metric_errors
    assert count.noise_std == 1.380859375 and users.noise_std == 0.6904296875 and count.absolute_error.rmse == pytest.approx(28.098163153)
    assert [(b.partition_size_from, b.partition_size_to) for b in r.utility_report_histogram] == [(10, 20)] and per_partition.count() == 10


def test_cross_grid_per_partition(grid):
    p = AggregateParams(metrics=[Metrics.COUNT], noise_kind=NoiseKind.GAUSSIAN, max_partitions_contributed=1, max_contributions_per_partition=2)
    _, rows = perform_utility_analysis(grid, UtilityAnalysisOptions(2, 1e-10, p), E, [f"pk{i}" for i in range(10)] + ["none"])
    r = rows.where("pk = 'pk0'").first()
    assert (r["count_to_max"], r["count_l0"]) == pytest.approx((-10, -18)) and math.sqrt(r["count_l0_var"]) == pytest.approx(1.89736, abs=1e-4)
    empty = rows.where("pk = 'none'").first()
    assert empty["units"] == 0 and empty["count_value"] == 0
    reports, _ = perform_utility_analysis(grid, UtilityAnalysisOptions(2, 1e-10, p), E, [f"pk{i}" for i in range(10)] + ["none"])
    assert (reports[0].partitions_info.num_dataset_partitions, reports[0].partitions_info.num_empty_partitions) == (10, 1)


def test_pre_threshold_selection(grid):
    keep = lambda **more: perform_utility_analysis(grid, UtilityAnalysisOptions(3, 0.9, AggregateParams(metrics=[], max_partitions_contributed=1, max_contributions_per_partition=2, **more)), E)[1].first()["keep"]
    assert keep() == pytest.approx(0.612579511, abs=1e-6) and keep(pre_threshold=3) == pytest.approx(0.0644512636, abs=1e-6)


def test_many_units_use_moments(spark):
    df = spark.createDataFrame([(i, f"pk{j}", 1.0) for i in range(150) for j in range(2)], "pid long, pk string, value double")
    p = AggregateParams(metrics=[Metrics.SUM], max_partitions_contributed=1, max_contributions_per_partition=1, min_sum_per_partition=0, max_sum_per_partition=1)
    _, rows = perform_utility_analysis(df, UtilityAnalysisOptions(1, 1e-5, p), E)
    assert 0 < rows.first()["keep"] <= 1


def test_multi_column_and_preaggregated(spark):
    df = spark.createDataFrame([(0, "pk0", 1.0, 5.0), (0, "pk1", 2.0, 1.0), (1, "pk0", 3.0, 1.0)], "pid long, pk string, a double, b double")
    p = AggregateParams(metrics=[Metrics.SUM], max_partitions_contributed=1, max_contributions_per_partition=1, min_sum_per_partition=0, max_sum_per_partition=1)
    config = MultiParameterConfiguration(max_partitions_contributed=[1, 2], min_sum_per_partition=[(0, 0), (0, 0)], max_sum_per_partition=[(2, 2), (9, 9)])
    _, rows = perform_utility_analysis(df, UtilityAnalysisOptions(1, 1e-5, p, config), DataExtractors("pid", "pk", ["a", "b"]), ["pk0", "pk1"])
    r = rows.where("pk = 'pk0' and config = 0").first()
    assert (r["sum0_value"], r["sum0_to_max"], r["sum1_value"], r["sum1_to_max"]) == (4, -1, 6, -3)
    pre = preaggregate(df, DataExtractors("pid", "pk", "a"))
    _, again = perform_utility_analysis(pre, UtilityAnalysisOptions(1, 1e-5, p, pre_aggregated_data=True), PreAggregateExtractors("pk", ["count", "sum", "n_partitions", "n_contributions"]), ["pk0"])
    assert again.first()["sum0_value"] == 4
    for bad in (dict(), dict(max_partitions_contributed=[1], max_contributions_per_partition=[1, 2]), dict(min_sum_per_partition=[1])):
        with pytest.raises(ValueError):
            MultiParameterConfiguration(**bad)


def test_preaggregate_golden(spark):
    df = spark.createDataFrame([(0, "pk0", 1.0)] + [(0, "pk1", v) for v in (5.0, 10.0)], "pid long, pk string, value double")
    assert sorted(map(tuple, preaggregate(df, E).collect())) == [("pk0", 1, 1, 2, 3), ("pk1", 2, 15, 2, 3)]


def test_candidates():
    assert constant_relative_step(1000, 5) == [1, 6, 32, 178, 1000] and constant_relative_step(3, 10) == [1, 2, 3] and constant_relative_step(9, 1) == [1]
    hist = h.Histogram(h.HistogramType.LINF_SUM_CONTRIBUTIONS, [h.FrequencyBin(i, i + 1, 1, i, i) for i in range(10)])
    assert bin_maxima(hist, 3) == [1, 5, 9]


def test_tune(grid):
    found = h.compute_dataset_histograms(grid, E)
    p = AggregateParams(metrics=[Metrics.COUNT], noise_kind=NoiseKind.GAUSSIAN, max_partitions_contributed=1, max_contributions_per_partition=1)
    options = TuneOptions(10, 1e-5, p, MinimizingFunction.ABSOLUTE_ERROR, ParametersToTune(max_partitions_contributed=True, max_contributions_per_partition=True), number_of_parameter_candidates=9)
    result, _ = tune(grid, found, options, E, [f"pk{i}" for i in range(10)])
    best = result.utility_analysis_parameters.max_partitions_contributed[result.index_best], result.utility_analysis_parameters.max_contributions_per_partition[result.index_best]
    assert best == (10, 3) and len(result.utility_reports) == 9
    with pytest.raises(NotImplementedError):
        tune(grid, found, TuneOptions(1, 1e-5, p, MinimizingFunction.RELATIVE_ERROR, ParametersToTune(noise_kind=True)), E)
    with pytest.raises(ValueError):
        ParametersToTune()


def test_strategy_selector():
    post = DPStrategySelector(2, 1e-12, [Metrics.PRIVACY_ID_COUNT], False)
    kinds = [post.get_dp_strategy(m.Sensitivities(l0=l0, linf=1)) for l0 in (1, 10, 25)]
    assert [k.noise_kind for k in kinds] == [NoiseKind.LAPLACE, NoiseKind.LAPLACE, NoiseKind.GAUSSIAN] and all(k.post_aggregation_thresholding for k in kinds)
    select = DPStrategySelector(1, 1e-5, [], False).get_dp_strategy(m.Sensitivities(l0=1, linf=1))
    assert select.noise_kind is None and select.partition_selection_strategy is PartitionSelectionStrategy.TRUNCATED_GEOMETRIC
    assert DPStrategySelector(1, 0, [Metrics.COUNT], True).get_dp_strategy(m.Sensitivities(l0=100, linf=1)).noise_kind is NoiseKind.LAPLACE
    with pytest.raises(ValueError):
        DPStrategySelector(1, 0, [Metrics.COUNT], False)


def test_public_summary(spark):
    s = compute_public_partitions_summary(spark.range(100).withColumnRenamed("id", "k"), ["k"], spark.range(60, 121).toDF("k"))
    assert (s.num_dataset_public_partitions, s.num_dataset_non_public_partitions, s.num_empty_public_partitions) == (40, 60, 21)
