"""Counts draw no sample of rows, functions of rows keep ids beside them, histograms of several columns read rows once."""

from hushframe import queries
from hushframe.budget import NaiveBudgetAccountant
from hushframe.extractors import DataExtractors
from hushframe.operators import histograms as h
from hushframe.params import CountParams
from hushframe.plans import bounding
from hushframe.private_frame import make_private


def test_counts_are_cut_off_without_a_sample(spark, monkeypatch):
    monkeypatch.setattr(bounding, "sample", lambda *_: 1 / 0)
    df = spark.createDataFrame([(u, k) for u in range(4) for k in "ab" for _ in range(5 if u else 1)], "u long, k string")
    accountant = NaiveBudgetAccountant(1e12, 1e-2)
    result = make_private(df, accountant, "u").count(CountParams(max_partitions_contributed=2, max_contributions_per_partition=3, partition_extractor="k"), ["a", "b"])
    accountant.compute_budgets()
    assert {r["k"]: round(r["count"]) for r in result.to_df().collect()} == {"a": 10, "b": 10}


def test_table_function_goes_by_rows(spark, monkeypatch):
    given = []
    made = queries.F.udtf
    monkeypatch.setattr(queries.F, "udtf", lambda *a, **k: given.append(k.get("useArrow")) or made(*a, **k))
    assert queries.private_frame_table_function(spark, "/root/testdata/sf0.001").count() == 10 and given == [None]


def test_row_functions_copy_no_ids(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, 3.0), (None, "z", 1.0)], "u long, a string, b double")
    private = make_private(df, NaiveBudgetAccountant(1, 1e-6), "u").flat_map(lambda row: [{"a": row["a"], "n": len(row)}, {"n": -1}] if row["u"] < 2 else [{}], schema="a string, n long")
    assert sorted(map(tuple, private._df.collect()), key=str) == sorted([(1, "x", 3), (1, None, -1), (2, None, None)], key=str)


def test_histograms_read_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    plain = spark.createDataFrame([(i % 7, "ab"[i % 2], float(i), i / 4) for i in range(60)], "u long, k string, x double, y double")
    found = h.compute_dataset_histograms(plain.mapInArrow(counted, plain.schema), DataExtractors("u", "k", ["x", "y"]))
    assert read.value == 60
    for i, c in enumerate("xy"):
        one = h.compute_dataset_histograms(plain, DataExtractors("u", "k", c))
        for name in ("linf_sum_contributions_histogram", "linf_sum_contributions_histogram_log", "sum_per_partition_histogram", "sum_per_partition_histogram_log"):
            assert getattr(found, name)[i] == getattr(one, name)
        assert (found.l0_contributions_histogram, found.l1_contributions_histogram, found.count_per_partition_histogram) == (one.l0_contributions_histogram, one.l1_contributions_histogram, one.count_per_partition_histogram)
