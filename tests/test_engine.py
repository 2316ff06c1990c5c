"""The engine end to end."""

import datetime
import os
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.plans.bounding import bound
from hushframe import (
    AddDPNoiseParams, AggregateParams, Budget, CalculatePrivateContributionBoundsParams, CountParams, CustomCombiner, DataExtractors, DPEngine, ExplainComputationReport, MeanParams, MechanismType, Metrics, NaiveBudgetAccountant, NoiseKind, NormKind,
    PartitionSelectionStrategy, PLDBudgetAccountant, PrivacyIdCountParams, QueryBuilder, Sampling, SelectPartitionsParams, SumParams, VarianceParams, make_private, of_row, register_annotator,
)
from hushframe import report
from hushframe.extractors import extract
from hushframe.operators.quantiles import LEAVES, QuantileTree, build_trees, merge_trees, release, unpack_trees
from hushframe.plans import columnar
from hushframe.plans.bounding import siphash
from hushframe.plans.columnar import ColumnarCombiner

E = DataExtractors("pid", "pk", "value")


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"pk{i // 2}", float(i)) for i in range(10)] + [(0, "pk0", None), (None, "pk0", 5.0), (1, None, 2.0)]
    return spark.createDataFrame(data, "pid long, pk string, value double")


def run(df, params, public=None, eps=1e9, delta=1e-2, e=E, accountant=None, **more):
    a = accountant or NaiveBudgetAccountant(eps, delta)
    result = DPEngine(a, **more).aggregate(df, params, e, public)
    a.compute_budgets()
    return {r["pk"]: r for r in result.to_df().collect()}


def test_large_budget_metrics(rows):
    p = AggregateParams(metrics=[Metrics.SUM, Metrics.COUNT, Metrics.PRIVACY_ID_COUNT], max_partitions_contributed=3, max_contributions_per_partition=5, min_value=0, max_value=8)
    got = run(rows, p, ["pk0", "pk4", "none", None])
    assert set(got) == {"pk0", "pk4", "none", None}
    assert got["pk4"]["sum"] == pytest.approx(16, abs=1e-3) and got["pk0"]["count"] == pytest.approx(2, abs=1e-3) and got["none"]["count"] == pytest.approx(0, abs=1e-3)
    assert got[None]["sum"] == pytest.approx(2, abs=1e-3) and got["pk0"]["privacy_id_count"] == pytest.approx(2, abs=1e-3)


def test_counts_keep_rows_without_a_value(rows):
    p = AggregateParams(metrics=[Metrics.COUNT], max_partitions_contributed=3, max_contributions_per_partition=5)
    assert run(rows, p, ["pk0"])["pk0"]["count"] == pytest.approx(3, abs=1e-3)


def test_noise_is_drawn_once(rows):
    p = AggregateParams(metrics=[Metrics.COUNT], max_partitions_contributed=3, max_contributions_per_partition=5, output_noise_stddev=True)
    a = NaiveBudgetAccountant(1, 1e-6)
    result = DPEngine(a).aggregate(rows, p, E, ["pk0", "pk1"])
    with pytest.raises(AssertionError):
        result.to_df()
    a.compute_budgets()
    df = result.to_df()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect())) == sorted(map(tuple, result.to_df().collect()))
    assert df.first()["count_noise_stddev"] == pytest.approx(15 * 2**0.5)


def test_small_budget_publishes_nothing(rows):
    p = AggregateParams(metrics=[Metrics.COUNT], max_partitions_contributed=1, max_contributions_per_partition=1)
    assert run(rows, p, eps=0.1, delta=1e-10) == {}


def test_bounds(spark):
    df = spark.createDataFrame([(1, f"p{i % 4}", 1.0) for i in range(40)], "pid long, pk string, value double")
    p = AggregateParams(metrics=[Metrics.COUNT], max_partitions_contributed=2, max_contributions_per_partition=3)
    public = [f"p{i}" for i in range(4)]
    assert sorted(round(r["count"]) for r in run(df, p, public).values()) == [0, 0, 3, 3]
    p = AggregateParams(metrics=[Metrics.COUNT], max_contributions=7)
    assert sum(round(r["count"]) for r in run(df, p, public).values()) == 7
    plan = df.groupBy("pid").count()
    assert plan is not None


def test_group_limits_run_before_the_exchange(spark):
    from hushframe.plans.bounding import Sampling, bound, sample

    df = spark.createDataFrame([(i % 3, i) for i in range(50)], "pid long, v long")
    text = sample(df, ["pid"], 2, Sampling("s", F.lit(0)).of_keys(["v"]))._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_mean_variance_golden(spark):
    df = spark.createDataFrame([(i, "pk1", -100.0) for i in range(30)] + [(i, "pk1", 100.0) for i in range(30, 40)], "pid long, pk string, value double")
    p = AggregateParams(metrics=[Metrics.VARIANCE, Metrics.MEAN], max_partitions_contributed=1, max_contributions_per_partition=1, min_value=1.55, max_value=2.7889)
    got = run(df, p, ["pk1"], eps=8e5)["pk1"]
    assert got["variance"] == pytest.approx(0.288, abs=1e-2) and got["mean"] == pytest.approx(1.86, abs=1e-2)


def test_percentiles_golden():
    p = AggregateParams(metrics=[Metrics.PERCENTILE(50)], max_partitions_contributed=1, max_contributions_per_partition=1, min_value=0, max_value=1000)
    leaves = {}
    for v in range(1001):
        at = min(LEAVES - 1, int(v / 1000 * LEAVES))
        leaves[at] = leaves.get(at, 0) + 1
    assert release(leaves, [0.1, 0.5, 0.9], p, 1e9, 0) == pytest.approx([100, 500, 900], abs=1)
    low = release(leaves, [0.9, 0.1], p, 0.5, 0)
    assert low[1] <= low[0] and 0 <= low[1] <= 1000


def test_vector_sum_norms(spark):
    df = spark.createDataFrame([(1, "a", [3.0, 4.0]), (2, "a", [0.3, 0.4])], "pid long, pk string, value array<double>")
    for norm, kind, first in ((NormKind.Linf, NoiseKind.LAPLACE, 1.3), (NormKind.L1, NoiseKind.LAPLACE, 3 / 7 + 0.3), (NormKind.L2, NoiseKind.GAUSSIAN, 0.6 + 0.3)):
        p = AggregateParams(metrics=[Metrics.VECTOR_SUM], noise_kind=kind, max_partitions_contributed=1, max_contributions_per_partition=1, vector_size=2, vector_max_norm=1.0, vector_norm_kind=norm)
        got = run(df, p, ["a", "empty"])
        assert got["a"]["vector_sum"][0] == pytest.approx(first, abs=1e-3) and got["empty"]["vector_sum"] == pytest.approx([0, 0], abs=1e-3)


def test_quantile_trees_merge():
    """The tree of a union is the merge of the trees, and equal trees have equal bytes."""
    r = random.Random(1)
    values = [r.choice((r.gauss(40, 30), 7.0, -5.0, 1e9)) for _ in range(3000)]
    parts = [QuantileTree.of_values(0, 100, values[a:b]) for a, b in ((0, 900), (900, 900), (900, 3000))]
    whole = QuantileTree.of_values(0, 100, values)
    assert parts[0].merge(*parts[1:]) == whole == parts[2].merge(parts[1]).merge(parts[0])
    assert QuantileTree.from_bytes(whole.to_bytes()) == whole and parts[0].merge(*parts[1:]).to_bytes() == whole.to_bytes()
    assert whole.count.sum() == whole.nodes(1).count.sum() == 3000 and whole.nodes(0).at.tolist() == [0]
    assert QuantileTree.of_values(3, 3, [1, float("nan"), 5]).count.tolist() == [2]
    p = AggregateParams(metrics=[Metrics.PERCENTILE(50)], max_partitions_contributed=1, max_contributions_per_partition=1, min_value=0, max_value=100)
    assert release(whole, [0.5], p, 1e9, 0)[0] == pytest.approx(sorted(values)[1500], abs=0.1)
    for wrong in (lambda: whole.merge(QuantileTree(0, 50)), lambda: QuantileTree(2, 1), lambda: release(QuantileTree(0, 50), [0.5], p, 1, 0)):
        with pytest.raises(ValueError):
            wrong()


def test_tables_of_trees(spark):
    """Trees of tables merge to those of their union; a tree over another interval is an error."""
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([r.uniform(-1, 11), None, float(i % 3)])) for i in range(2000)]
    schema = "k string, value double"
    tree = lambda rows: build_trees(spark.createDataFrame(rows, schema).repartition(3), ["k"], "value", 0, 10)
    merged = merge_trees(tree(rows[:500]).union(tree(rows[500:700])).union(tree(rows[700:])), ["k"], 0, 10)
    known = {k: QuantileTree.of_values(0, 10, [float("nan") if v is None else v for x, v in rows if x == k]).to_bytes() for k in ("a", "b", None)}
    assert {x["k"]: bytes(x["tree"]) for x in merged.collect()} == {x["k"]: bytes(x["tree"]) for x in tree(rows).collect()} == known
    assert unpack_trees(merged, ["k"], 0, 10).groupBy().sum("n").first()[0] == sum(v is not None for _, v in rows)
    assert tree([]).collect() == [] and merge_trees(tree([]), ["k"], 0, 10).collect() == []
    with pytest.raises(Exception, match="is not one over"):
        merge_trees(tree(rows), ["k"], 0, 11).collect()


def test_percentiles_of_merged_states(spark):
    df = spark.createDataFrame([(u, f"p{u % 2}", float(u + v)) for u in range(400) for v in range(3)], "pid long, pk string, value double")
    p = AggregateParams(metrics=[Metrics.PERCENTILE(50), Metrics.PERCENTILE(90)], max_partitions_contributed=1, max_contributions_per_partition=3, min_value=0, max_value=1000)
    a = NaiveBudgetAccountant(1e9, 1e-2)
    engine = DPEngine(a)
    states = engine.percentile_states(df.where("pid < 100"), p, E).union(engine.percentile_states(df.where("pid >= 100"), p, E))
    assert states.columns == ["pk", "units", "tree"] and states.groupBy().sum("units").first()[0] == 400
    merged, public = engine.release_percentiles(states, p), engine.release_percentiles(states, p, ["p0", "none"], tables_per_unit=2)
    whole = DPEngine(a).aggregate(df, p, E)
    a.compute_budgets()
    got, expected = ({x["pk"]: tuple(x)[1:] for x in y.to_df().collect()} for y in (merged, whole))
    assert set(got) == set(expected) == {"p0", "p1"} and all(got[k] == pytest.approx(expected[k], abs=0.05) for k in got)
    assert {x["pk"] for x in public.to_df().collect()} == {"p0", "none"}
    for wrong in (lambda: engine.release_percentiles(states, p, tables_per_unit=0), lambda: engine.percentile_states(df, AggregateParams(metrics=[Metrics.COUNT], max_partitions_contributed=1, max_contributions_per_partition=1), E)):
        with pytest.raises(ValueError):
            wrong()


def test_vector_sum_of_many_coordinates(spark):
    """Plans don't grow with the vector; copies of a unit's rows beyond its bound don't count."""
    size = 4096
    df = spark.range(600).select((F.col("id") % 300).alias("pid"), (F.col("id") % 3).alias("pk"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i + F.col("id")).cast("double") / 1e4).alias("value"))
    p = AggregateParams(metrics=[Metrics.VECTOR_SUM, Metrics.PRIVACY_ID_COUNT], max_partitions_contributed=1, max_contributions_per_partition=2, vector_size=size, vector_max_norm=1e6, vector_norm_kind=NormKind.Linf)
    a = NaiveBudgetAccountant(1e13, 1e-2)
    result = DPEngine(a).aggregate(df, p, E, [0, 1, 2, 9])
    a.compute_budgets()
    got = {x["pk"]: x for x in result.to_df().collect()}
    assert len(result._build()._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    for k in range(3):
        ids = range(k, 600, 3)
        assert got[k]["vector_sum"] == pytest.approx([sum(i + d for i in ids) / 1e4 for d in range(size)], abs=1e-2) and round(got[k]["privacy_id_count"]) == 100
    assert got[9]["vector_sum"] == pytest.approx([0] * size, abs=1e-2)


def test_vectors_of_other_lengths(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "a", [1.0, None, 5.0]), (3, "a", []), (4, "a", None)], "pid long, pk string, value array<double>")
    p = AggregateParams(metrics=[Metrics.VECTOR_SUM], max_partitions_contributed=1, max_contributions_per_partition=1, vector_size=2, vector_max_norm=9.0, vector_norm_kind=NormKind.Linf)
    assert run(df, p, ["a"])["a"]["vector_sum"] == pytest.approx([2, 0], abs=1e-3)


class Words(ColumnarCombiner):
    """Distinct rounded values: states are lists of any length."""

    def request_budget(self, accountant):
        accountant.request_budget(MechanismType.LAPLACE)

    def state_schema(self):
        return "seen array<double>"

    def output_schema(self):
        return "seen array<double>, n int, label string"

    def _sets(self, values, group, n):
        sets = [sorted({v for v, g in zip(values, group.tolist()) if g == i}) for i in range(n)]
        return {"seen": pa.array(sets, pa.list_(pa.float64()))}

    def start(self, values, group, n):
        return self._sets(values.to_pylist(), group, n)

    def merge(self, states, group, n):
        lists = states["seen"].to_pylist()
        return self._sets([v for x in lists for v in x], np.repeat(group, [len(x) for x in lists]).astype(int), n)

    def compute_metrics(self, states):
        lists = states["seen"].to_pylist()
        return {"seen": states["seen"], "n": [len(x) for x in lists], "label": [str(len(x)) for x in lists]}


@pytest.mark.parametrize("held", [1, 1 << 14])
def test_columnar_combiner(spark, monkeypatch, held):
    """States of any length and results of any type, beside a combiner of the row protocol."""
    monkeypatch.setattr(columnar, "HELD", held)
    rows = [(u, f"p{u % 40}" if u % 41 else None, float(u % 7 + v)) for u in range(500) for v in range(2)]
    df = spark.createDataFrame(rows, "pid long, pk string, value double").repartition(5)
    p = AggregateParams(custom_combiners=[Words(), SumOfSquares()], max_partitions_contributed=1, max_contributions_per_partition=2)
    got = run(df, p)
    keys = {k for _, k, _ in rows}
    assert set(got) == keys
    for k in keys:
        own = [v for _, x, v in rows if x == k]
        assert (got[k]["seen"], got[k]["n"], got[k]["label"], got[k]["squares"]) == (sorted(set(own)), len(set(own)), str(len(set(own))), sum(v * v for v in own))
    public = run(df, p, ["p1", "none"])
    assert set(public) == {"p1", "none"} and public["none"]["seen"] == [] and public["none"]["squares"] == 0
    assert p.custom_combiners[0].metrics_names() == ["seen", "n", "label"]


def test_functions_of_rows_extract(spark):
    """Python functions of rows, alone and beside columns, over nulls and unused columns."""
    rows = [(i % 5 if i % 7 else None, {"k": f"p{i % 2}"}, [i, i + 1], "x") for i in range(70)]
    df = spark.createDataFrame(rows, "user long, nested map<string,string>, list array<int>, other string").repartition(3)
    p = AggregateParams(metrics=[Metrics.COUNT, Metrics.SUM], max_partitions_contributed=2, max_contributions_per_partition=70, min_value=0, max_value=1000)
    kept = [r for r in rows if r[0] is not None]
    expected = {k: (sum(r[1]["k"] == k for r in kept), sum(r[2][1] for r in kept if r[1]["k"] == k)) for k in ("p0", "p1")}
    functions = DataExtractors(of_row(lambda row: row.user, "long"), of_row(lambda row: row["nested"]["k"], "string"), of_row(lambda row: row[2][1], T.DoubleType()))
    mixed = DataExtractors("user", of_row(lambda row: row.nested["k"], "string"), F.col("list")[1])
    keys = DataExtractors(of_row(lambda row: row.user, "long"), ["other", of_row(lambda row: row.nested["k"], "string")], lambda frame: frame["list"][1])
    for e in (functions, mixed, keys):
        a = NaiveBudgetAccountant(1e9, 1e-2)
        result = DPEngine(a).aggregate(df, p, e)
        a.compute_budgets()
        out = result.to_df()
        assert {r[out.columns.index("count") - 1]: (round(r["count"]), round(r["sum"])) for r in out.collect()} == expected
    twice = df.select("user", F.col("nested").alias("user"), "list")
    made, names = extract(twice, DataExtractors(of_row(lambda row: row[0], "long"), of_row(lambda row: row[1]["k"], "string"), None))
    assert names == ["partition_key"] and made.count() == len(kept)
    with pytest.raises(ValueError):
        extract(twice, DataExtractors(of_row(lambda row: row[0], "long"), F.lit("x"), None))


class Twice:
    def eval(self, text: str):
        for word in (text or "").split():
            yield word, len(word)


class Ends(Twice):
    def terminate(self):
        yield "x", 1


def test_table_functions_of_private_rows(spark):
    df = spark.createDataFrame([(1, "a bb", 7), (2, "a", 7), (None, "z", 7), (3, None, 7)], "pid long, text string, w int")
    private = make_private(df, NaiveBudgetAccountant(1, 1e-6), "pid")
    out = private.table_function(F.udtf(Twice, returnType="w string, n int", useArrow=True), "text")
    assert out.columns == ["w", "n"]
    assert sorted(map(tuple, out._df.collect())) == [(1, "a", 1), (1, "bb", 2), (2, "a", 1)]
    with pytest.raises(ValueError, match="terminate"):
        private.table_function(F.udtf(Ends, returnType="w string, n int"), "text")
    with pytest.raises(ValueError, match="rewritten"):
        private.table_function(F.udtf(Twice, returnType="__privacy_id string, n int"), "text")


def levels_of(df, p, public=None, eps=1e9, delta=1e-2, levels=((), ("a",), ("b", "a")), accountant=None):
    a = accountant or NaiveBudgetAccountant(eps, delta)
    result = DPEngine(a).aggregate_levels(df, p, DataExtractors("pid", ["a", "b"], "value"), levels, public)
    a.compute_budgets()
    return result.to_df()


def test_levels_of_keys(spark):
    """One bounded pass, several levels; null keys are keys."""
    r = random.Random(4)
    rows = [(r.randrange(40), r.choice(["x", "y", None]), r.choice([1, 2, None]), r.choice([1.0, 5.0, 50.0, None])) for _ in range(600)]
    df = spark.createDataFrame(rows, "pid long, a string, b long, value double")
    p = AggregateParams(metrics=[Metrics.COUNT, Metrics.SUM, Metrics.PRIVACY_ID_COUNT], max_partitions_contributed=9, max_contributions_per_partition=600, min_value=0, max_value=10)
    got = {(x["level"], x["a"], x["b"]): (round(x["count"]), round(x["sum"]), round(x["privacy_id_count"])) for x in levels_of(df, p).collect()}
    expected = {}
    for level, cut in enumerate((lambda a, b: (None, None), lambda a, b: (a, None), lambda a, b: (a, b))):
        for u, a, b, v in rows:
            if v is not None:
                n, total, units = expected.get((level, *cut(a, b)), (0, 0, frozenset()))
                expected[level, *cut(a, b)] = (n + 1, total + min(v, 10), units | {u})
    assert got == {k: (n, total, len(units)) for k, (n, total, units) in expected.items()}
    mean = AggregateParams(metrics=[Metrics.MEAN], max_partitions_contributed=9, max_contributions_per_partition=600, min_value=0, max_value=10)
    for x in levels_of(df, mean).collect():
        n, total, _ = expected[x["level"], x["a"], x["b"]]
        assert x["mean"] == pytest.approx(total / n, abs=1e-3)
    public = levels_of(df, p, [("x", 1), ("x", 7), ("z", 2)])
    assert sorted((x["level"], x["a"] or "", x["b"] or 0) for x in public.collect()) == [(0, "", 0), (1, "x", 0), (1, "z", 0), (2, "x", 1), (2, "x", 7), (2, "z", 2)]
    total = [round(x["count"]) for x in public.collect() if x["level"] == 0]
    assert total == [expected[2, "x", 1][0]]


def test_levels_are_bounded_once_and_share_the_budget(spark):
    df = spark.createDataFrame([(u, f"a{i}", i, 1.0) for u in range(3) for i in range(50)], "pid long, a string, b long, value double")
    p = AggregateParams(metrics=[Metrics.COUNT], max_partitions_contributed=4, max_contributions_per_partition=2, output_noise_stddev=True)
    public = [(f"a{i}", i) for i in range(50)]
    out = levels_of(df, p, public, levels=((), ("a", "b")), eps=1e7).collect()
    assert {round(sum(x["count"] for x in out if x["level"] == level)) for level in (0, 1)} == {12}
    # each level has half the budget, and both the sensitivity 4 * 2
    assert {round(x["count_noise_stddev"] * 1e7, 3) for x in out} == {round(2 * 8 * 2**0.5, 3)}
    gauss = replace(p, noise_kind=NoiseKind.GAUSSIAN)
    spread = {x["level"]: x["count_noise_stddev"] for x in levels_of(df, gauss, public, levels=((), ("a", "b")), eps=1, delta=1e-6).collect()}
    assert spread[0] / spread[1] == pytest.approx(2, rel=0.01)  # 8 against 2 * sqrt(4)
    assert levels_of(df, p, eps=0.01, delta=1e-10).collect() == []
    for levels, params in ((((), ()), p), ((("c",),), p), ((), p), (((),), AggregateParams(metrics=[Metrics.VARIANCE], max_partitions_contributed=1, max_contributions_per_partition=1, min_value=0, max_value=1))):
        with pytest.raises(ValueError):
            levels_of(df, params, levels=levels)


def test_results_can_be_deleted(spark, rows):
    p = AggregateParams(metrics=[Metrics.COUNT], max_partitions_contributed=3, max_contributions_per_partition=5)
    a = NaiveBudgetAccountant(1, 1e-6)
    result = DPEngine(a).aggregate(rows, p, E, ["pk0"])
    a.compute_budgets()
    with result:
        assert result.to_df().count() == 1
        assert os.path.isdir(result._path.removeprefix("file:"))
    assert not os.path.exists(result._path.removeprefix("file:"))
    with pytest.raises(ValueError):
        result.to_df()


def test_siphash():
    """Two published values."""
    key = bytes(range(16))
    assert siphash(np.zeros((1, 0), np.uint64), key)[0] == 0x726FDB47DD0E0E31
    assert siphash(np.frombuffer(bytes(range(8)), "<u8").reshape(1, 1), key)[0] == 0x93F5F5799A932462


@pytest.mark.parametrize("total", [False, True])
def test_secret_is_in_no_plan(rows, total):
    sampling = Sampling()
    p = AggregateParams(metrics=[Metrics.COUNT], **({"max_contributions": 2} if total else {"max_partitions_contributed": 1, "max_contributions_per_partition": 1}))
    a = NaiveBudgetAccountant(1e9, 1e-2)
    result = DPEngine(a, sampling).aggregate(rows, p, E, ["pk0"])
    a.compute_budgets()
    execution = result._build()._jdf.queryExecution()
    texts = [execution.logical().toString(), execution.analyzed().toString(), execution.optimizedPlan().toString(), execution.executedPlan().toString(), execution.toString(), execution.analyzed().toJSON(), repr(sampling)]
    numbers = np.frombuffer(bytes.fromhex(sampling.secret), "<i8").tolist()
    for text in texts:
        assert not any(part in text for part in (sampling.secret, sampling.secret[:8], *map(str, numbers)))


class SumOfSquares(CustomCombiner):
    def request_budget(self, accountant):
        self.budget = accountant.request_budget(MechanismType.LAPLACE)

    def create_accumulator(self, values):
        return sum(v * v for v in values)

    def merge_accumulators(self, a, b):
        return a + b

    def compute_metrics(self, accumulator):
        return {"squares": accumulator}

    def metrics_names(self):
        return ["squares"]


def test_custom_combiner(rows):
    p = AggregateParams(custom_combiners=[SumOfSquares()], max_partitions_contributed=3, max_contributions_per_partition=3)
    got = run(rows.where("value is not null"), p, ["pk1", "none"])
    assert got["pk1"]["squares"] == 13 and got["none"]["squares"] == 0
    private = make_private(rows.where("value is not null"), a := NaiveBudgetAccountant(1e6, 1e-2), "pid")
    result = private.combine(SumOfSquares(), p.__class__(metrics=[Metrics.COUNT], max_partitions_contributed=3, max_contributions_per_partition=3), "pk", "value", ["pk2"])
    a.compute_budgets()
    assert result.collect()[0]["squares"] == 41


def test_select_partitions_strategies(spark):
    df = spark.createDataFrame([(u, k) for u in range(50) for k in ("big", "large")] + [(99, "rare")], "pid long, pk string")
    for strategy in PartitionSelectionStrategy:
        a = NaiveBudgetAccountant(50, 1e-3)
        result = DPEngine(a).select_partitions(df, SelectPartitionsParams(max_partitions_contributed=2, partition_selection_strategy=strategy, pre_threshold=5), DataExtractors("pid", "pk"))
        a.compute_budgets()
        assert {r["pk"] for r in result.to_df().collect()} == {"big", "large"}


def test_post_aggregation_and_pld(spark):
    df = spark.createDataFrame([(u, k, 1.0) for u in range(200) for k in ("a", "b")] + [(1, "rare", 1.0)], "pid long, pk string, value double")
    p = AggregateParams(metrics=[Metrics.PRIVACY_ID_COUNT, Metrics.COUNT], max_partitions_contributed=3, max_contributions_per_partition=1, post_aggregation_thresholding=True)
    got = run(df, p, eps=5, delta=1e-6)
    assert set(got) == {"a", "b"} and got["a"]["privacy_id_count"] == pytest.approx(200, abs=40)
    p = AggregateParams(metrics=[Metrics.COUNT, Metrics.SUM], max_partitions_contributed=3, max_contributions_per_partition=1, min_value=0, max_value=1, partition_selection_strategy=PartitionSelectionStrategy.GAUSSIAN_THRESHOLDING)
    got = run(df, p, accountant=PLDBudgetAccountant(5, 1e-5, 1e-2))
    assert set(got) == {"a", "b"} and got["b"]["count"] == pytest.approx(200, abs=60)


def test_wrong_arguments(rows):
    a = NaiveBudgetAccountant(1, 1e-6)
    engine = DPEngine(a)
    p = AggregateParams(metrics=[Metrics.COUNT], max_partitions_contributed=1, max_contributions_per_partition=1)
    with pytest.raises(TypeError):
        engine.aggregate([1], p, E)
    with pytest.raises(ValueError):
        engine.aggregate(rows, None, E)
    with pytest.raises(TypeError):
        engine.aggregate(rows, p, object())
    with pytest.raises(ValueError):
        engine.aggregate(rows, p, DataExtractors(None, "pk", "value"))
    with pytest.raises(NotImplementedError):
        engine.aggregate(rows, AggregateParams(metrics=[Metrics.VARIANCE], max_contributions=1, min_value=0, max_value=1), E)
    with pytest.raises(NotImplementedError):
        DPEngine(PLDBudgetAccountant(1, 1e-6)).aggregate(rows, AggregateParams(custom_combiners=[SumOfSquares()], max_partitions_contributed=1, max_contributions_per_partition=1), E)


@pytest.mark.parametrize("kind", [NoiseKind.LAPLACE, NoiseKind.GAUSSIAN])
def test_composed_losses_of_every_metric(spark, kind):
    """Variance, percentiles and vectors under privacy-loss accounting."""
    df = spark.createDataFrame([(i, "a", float(i % 10), [float(i % 3), 1.0]) for i in range(3000)], "pid long, pk string, value double, vector array<double>")
    same = dict(max_partitions_contributed=1, max_contributions_per_partition=1, noise_kind=kind)
    p = AggregateParams(metrics=[Metrics.VARIANCE, Metrics.MEAN, Metrics.PERCENTILE(50)], min_value=0, max_value=10, **same)
    got = run(df, p, ["a"], accountant=PLDBudgetAccountant(20, 1e-6, 1e-2))["a"]
    assert got["variance"] == pytest.approx(8.25, abs=0.3) and got["mean"] == pytest.approx(4.5, abs=0.1) and got["percentile_50"] == pytest.approx(4.5, abs=1)
    v = AggregateParams(metrics=[Metrics.VECTOR_SUM], vector_size=2, vector_max_norm=2.0, vector_norm_kind=NormKind.Linf, **same)
    got = run(df, v, ["a"], accountant=PLDBudgetAccountant(20, 1e-6, 1e-2), e=DataExtractors("pid", "pk", "vector"))["a"]
    assert got["vector_sum"] == pytest.approx([3000, 3000], abs=15)


def test_report_and_annotator(rows):
    a, out, seen = NaiveBudgetAccountant(1, 1e-6, num_aggregations=1), ExplainComputationReport(), []
    with pytest.raises(ValueError):
        out.text()
    register_annotator(lambda df, **what: seen.append(what) or df)
    try:
        p = AggregateParams(metrics=[Metrics.COUNT], max_partitions_contributed=2, max_contributions_per_partition=1)
        engine = DPEngine(a)
        result = engine.aggregate(rows, p, E, out_explain_computation_report=out)
        with pytest.raises(ValueError):
            out.text()
        a.compute_budgets()
        result.to_df()
    finally:
        report._annotators.clear()
    text = out.text()
    for line in ("DPEngine method: aggregate", "Partition selection: private partitions", "Per-partition contribution bounding", "Cross-partition contribution bounding", "Truncated Geometric", "Computed DP count"):
        assert line in text
    assert engine.explain_computations_report() == [text] and seen[0]["budget"].epsilon == 1


def test_add_noise_arrays(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "k string, value array<double>")
    a = NaiveBudgetAccountant(1e9, 1e-2)
    result = DPEngine(a).add_dp_noise(df, AddDPNoiseParams(NoiseKind.GAUSSIAN, l2_sensitivity=1, output_noise_stddev=True))
    a.compute_budgets()
    r = result.to_df().first()
    assert r["value"] == pytest.approx([1, 2], abs=1e-3) and r["noise_stddev"] > 0


def test_private_contribution_bounds(spark):
    df = spark.createDataFrame([("pk0", 0)], "pk string, pid long").union(spark.range(1, 5001).select(F.explode(F.array(F.lit("pk0"), F.lit("pk1"))).alias("pk"), F.col("id")))
    params = CalculatePrivateContributionBoundsParams(NoiseKind.LAPLACE, 0.9, 0, 0.9, 2)
    engine = DPEngine(NaiveBudgetAccountant(1, 1e-6))
    e = DataExtractors("pid", "pk")
    assert engine.calculate_private_contribution_bounds(df, params, e, ["pk0", "pk1"]).max_partitions_contributed == 2
    assert engine.calculate_private_contribution_bounds(df, params, e, ["pk0"]).max_partitions_contributed == 1


def test_private_frame(rows):
    a = NaiveBudgetAccountant(1e9, 1e-2)
    private = make_private(rows, a, "pid")
    assert "__privacy_id" not in private.columns
    with pytest.raises(ValueError):
        private.with_column("__privacy_id", F.lit(1))
    mapped = private.select("pk", (F.col("value") * 2).alias("value")).filter("value is not null")
    s = mapped.sum(SumParams(3, 3, 0, 100, "pk", "value"), ["pk1"])
    mean = mapped.mean(MeanParams(3, 3, 0, 100, "pk", "value"), ["pk1"])
    v = mapped.variance(VarianceParams(3, 3, 0, 100, "pk", "value"), ["pk1"])
    n = mapped.privacy_id_count(PrivacyIdCountParams(max_partitions_contributed=3, partition_extractor="pk"), ["pk1"])
    c = mapped.count(CountParams(max_partitions_contributed=3, max_contributions_per_partition=3, partition_extractor="pk"), ["pk1"])
    k = mapped.select_partitions(SelectPartitionsParams(3), "pk")
    a.compute_budgets()
    value = lambda r, name: r.collect()[0][name]
    assert value(s, "sum") == pytest.approx(10, abs=1e-2) and value(mean, "mean") == pytest.approx(5, abs=1e-2) and value(v, "variance") == pytest.approx(1, abs=1e-2)
    assert value(n, "privacy_id_count") == pytest.approx(2, abs=1e-2) and value(c, "count") == pytest.approx(2, abs=1e-2) and k.to_df().count() == 5


def test_query_builder_errors(rows):
    b = QueryBuilder(rows, "pid")
    with pytest.raises(ValueError):
        QueryBuilder(rows, "none")
    with pytest.raises(NotImplementedError):
        b.count().build_query()
    g = lambda: QueryBuilder(rows, "pid").groupby("pk", max_groups_contributed=1, max_contributions_per_group=1)
    for bad in (lambda: g().build_query(), lambda: g().count().count().build_query(), lambda: g().sum("value").build_query(), lambda: g().groupby("pk", max_groups_contributed=1, max_contributions_per_group=1),
                lambda: g().sum("value", min_value=0, max_value=1).mean("value", min_value=0, max_value=2).build_query(), lambda: g().sum("none", min_value=0, max_value=1), lambda: QueryBuilder(rows, "pid").groupby("none", max_groups_contributed=1, max_contributions_per_group=1)):
        with pytest.raises(ValueError):
            bad()


def test_two_keys_and_names(spark):
    df = spark.createDataFrame([(0, "key1", "a", 5.0), (1, "key2", "b", 2.5), (1, "key1", "c", -2.0)], "privacy_key long, group_key string, second string, value double")
    q = QueryBuilder(df, "privacy_key").groupby(["group_key", "second"], max_groups_contributed=2, max_contributions_per_group=2, public_keys=[("key1", "a"), ("key0", "b")]).count("n").sum("value", min_value=1, max_value=2, name="s").build_query()
    out = q.run_query(Budget(1e6, 1e-1))
    assert out.columns == ["group_key", "second", "n", "s"]
    got = {(r[0], r[1]): (round(r[2]), round(r[3])) for r in out.collect()}
    assert got == {("key1", "a"): (1, 2), ("key0", "b"): (0, 0)}


def test_streaming_windows(spark, tmp_path):
    from hushframe.streaming import stream_dp_counts

    t = datetime.datetime(2024, 1, 1)
    data = [(t + datetime.timedelta(minutes=m), u, k) for u in range(20) for m, k in ((1, "a"), (2, "a"), (3, "b"), (12, "a"), (45, "b"))]
    spark.createDataFrame(data, "ts timestamp, user long, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user long, kind string").parquet(str(tmp_path / "in"))
    q = stream_dp_counts(stream, "ts", "user", "kind", window="10 minutes", lateness="5 minutes", budget=Budget(1e9, 1e-2), max_keys=2, max_per_key=5, public_keys=["a", "b", "c"], sink=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    got = {(r["begin"].minute, r["key"]): round(r["dp_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[(0, "a")] == 40 and got[(0, "b")] == 20 and got[(0, "c")] == 0 and got[(10, "a")] == 20 and (40, "b") not in got


def test_sources(spark, tmp_path):
    from hushframe.sources import read_csv, read_sectioned_text, write_csv, write_text

    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "csv")).collect())) == [(1, "x"), (2, "y")]
    write_text(df, str(tmp_path / "txt"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "txt")).collect()) == ["1,x", "2,y"]
    lines, expected = [], []
    for movie in range(1, 60):
        lines.append(f"{movie}:")
        for user in range(movie % 7 * 5):
            lines.append(f"{user},{user % 5},2005-01-01")
            expected.append((str(movie), str(user), str(user % 5)))
    (tmp_path / "views.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = read_sectioned_text(spark, str(tmp_path / "views.txt"), ["user", "rating", "date"], "movie")
        assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(expected)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_weighted_gaussian_selection(spark):
    def published(units, keys):
        df = spark.createDataFrame([(u, k) for u in range(units) for k in range(keys)], "pid long, pk long")
        a = NaiveBudgetAccountant(1, 1e-6)
        result = DPEngine(a).select_partitions(df, SelectPartitionsParams(max_partitions_contributed=10, partition_selection_strategy=PartitionSelectionStrategy.WEIGHTED_GAUSSIAN_THRESHOLDING), DataExtractors("pid", "pk"))
        a.compute_budgets()
        return result.to_df().count()

    assert published(300, 1) == 1 and published(20, 1) == 0 and published(50, 10) == 0


def test_sampling_survives_another_order_of_rows(spark):
    """What a unit keeps doesn't depend on how a repeated task reads its rows."""
    rows = [(p, f"k{k}", float(v)) for p in range(6) for k in range(8) for v in (1, 1, 2, 3, None) if v is not None]
    schema, sampling = "pid long, k0 string, value double", Sampling()
    p = AggregateParams(metrics=[Metrics.COUNT], max_partitions_contributed=3, max_contributions_per_partition=2)
    total = AggregateParams(metrics=[Metrics.COUNT], max_contributions=5)
    for params in (p, total):
        kept = []
        for n, order in ((1, rows), (4, rows[::-1]), (7, rows[100:] + rows[:100])):
            df = spark.createDataFrame(order, schema).repartition(n)
            out, _ = bound(df, ["k0"], params, [F.count("*").alias("n"), F.sum("value").alias("s")], True, sampling)
            kept.append(sorted(map(tuple, out.collect())))
        assert kept[0] == kept[1] == kept[2]
        other, _ = bound(spark.createDataFrame(rows, schema), ["k0"], params, [F.count("*").alias("n"), F.sum("value").alias("s")], True, Sampling())
        assert sorted(map(tuple, other.collect())) != kept[0]


def test_sampling_of_equal_rows_is_uniform(spark):
    """Of a thousand units with the values a, a, b one row is kept: b by a third of them."""
    rows = [(p, "k", v) for p in range(1000) for v in (1.0, 1.0, 2.0)]
    p = AggregateParams(metrics=[Metrics.COUNT], max_partitions_contributed=1, max_contributions_per_partition=1)
    out, _ = bound(spark.createDataFrame(rows, "pid long, k0 string, value double"), ["k0"], p, [F.sum("value").alias("s")], True, Sampling())
    assert 260 <= out.where("s = 2").count() <= 410 and out.count() == 1000


def test_functions_of_private_rows(rows):
    private = make_private(rows, NaiveBudgetAccountant(1, 1e-6), "pid")
    doubled = private.map(lambda row: {"pk": row["pk"], "value": 2.0}, schema="pk string, value double")
    split = private.flat_map(lambda row: [{"pk": row["pk"]}] * 2, schema="pk string").filter(lambda row: row["pk"] == "pk1")
    assert doubled.columns == ["pk", "value"] and split._df.count() == 2 * rows.where("pk = 'pk1' and pid is not null").count()
    assert {r[0] for r in split._df.select("__privacy_id").collect()} == {r[0] for r in rows.where("pk = 'pk1' and pid is not null").select("pid").collect()}
    with pytest.raises(ValueError):
        private.map(lambda row: row)
    with pytest.raises(ValueError):
        private.map(lambda row: row, schema="__privacy_id long")
