"""Sums on the edge of a bin, whatever the order in which their doubles are added."""

import functools
import operator

from pyspark.sql import functions as F

from hushframe.analysis.preaggregate import preaggregate
from hushframe.extractors import DataExtractors, extract
from hushframe.operators import histograms as h

EVENT = DataExtractors("user_id", "event_type", "value")


def _edge(spark):
    """700.00 as cents that doubles sum to less or more than it, by their order."""
    values = [0.1] * 7000
    return spark.createDataFrame([(1, "a", v) for v in values] + [(2, "a", 1e300), (2, "a", 1e300), (3, "a", None), (4, "a", 1e-30)], "user_id long, event_type string, value double").repartition(3)


def test_sum_on_a_bin_edge(spark):
    assert functools.reduce(operator.add, [0.1] * 7000) != 700.0
    rows, _ = extract(_edge(spark), EVENT)
    sums = {r["pid"]: r["s"] for r in h.Counts(rows, ["k0"]).pairs.collect()}
    assert sums == {1: 700.0, 2: 2e300, 3: None, 4: 1e-30}
    (b,) = h.collected(h.Counts(rows.where("pid = 1"), ["k0"]).linf_sum(True))
    assert (b.lower, b.upper, b.count) == (700.0, 710.0, 1)


def test_sums_that_decimals_do_not_hold(spark):
    df = spark.createDataFrame([("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("big", 9e19), ("big", 9e19), ("cancel", 0.3), ("cancel", -0.3)], "k string, v double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(h.exact_sum(F.col("v")).alias("s")).collect()}
    assert got["nan"] != got["nan"] and got["inf"] == float("inf") and got["big"] == 1.8e20 and got["cancel"] == 0.0


def test_preaggregated_sum_on_a_bin_edge(spark):
    assert {r["sum"] for r in preaggregate(_edge(spark), EVENT).collect()} == {700.0, 2e300, None, 1e-30}
    (b,) = h.collected(h.PreaggregatedCounts(preaggregate(_edge(spark).where("user_id = 1"), EVENT), ["event_type"]).linf_sum(True))
    assert (b.lower, b.upper, b.count) == (700.0, 710.0, 1)
