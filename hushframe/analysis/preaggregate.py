"""Pre-aggregation: one row for each (unit, partition), on which analysis runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..extractors import DataExtractors, PreAggregateExtractors, columns, extract, key_names
from ..operators.histograms import exact_sum, sums_in_order
from ..operators.sampling import ValueSampler


def kept_partitions(keys: list[str], probability: float) -> Column:
    """Deterministic sample of partitions by a hash of the key."""
    if len(keys) == 1:
        return ValueSampler(probability).condition(F.col(keys[0]), text=True) if probability < 1 else F.lit(True)
    joined = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return ValueSampler(probability).condition(joined, text=True) if probability < 1 else F.lit(True)


def preaggregated_rows(df: DataFrame, e: DataExtractors, public: DataFrame | None = None, sampling_prob: float = 1.0, l0: bool = True, order: Column | None = None) -> tuple[DataFrame, list[str]]:
    """(k0, ..., count, sum, n_partitions, n_contributions).  Partitions are sampled after a
    unit's totals are known, so that they stay right.  With ``order`` the values of a pair,
    one column, are added as doubles in its order."""
    rows, names = extract(df, e, order)
    keys = [f"k{i}" for i in range(len(names))]
    if public is not None:
        from ..engine import same_keys

        rows = rows.join(public, same_keys(rows, public, keys), "left_semi")
    array = rows.schema["value"].dataType.typeName() == "array"
    width = len(e.value_extractor) if array else 0
    if order is not None:
        pairs = sums_in_order(rows, ["pid", *keys], "row_id").withColumnsRenamed({"v": "count", "s": "sum"})
    else:
        total = F.array(*[exact_sum(F.get("value", i)) for i in range(width)]) if array else exact_sum(F.col("value"))
        pairs = rows.groupBy("pid", *keys).agg(F.count("*").alias("count"), total.alias("sum"))
    if l0:
        unit = Window.partitionBy("pid")
        pairs = pairs.withColumn("n_partitions", F.count("*").over(unit)).withColumn("n_contributions", F.sum("count").over(unit))
    else:
        pairs = pairs.withColumn("n_partitions", F.lit(1).cast("long")).withColumn("n_contributions", F.col("count"))
    return pairs.where(kept_partitions(keys, sampling_prob)).select(*keys, "count", "sum", "n_partitions", "n_contributions"), names


def preaggregate(df: DataFrame, data_extractors: DataExtractors, public_partitions: DataFrame | None = None, partitions_sampling_prob: float = 1.0, order: Column | None = None) -> DataFrame:
    """The pre-aggregated rows under the key's own names."""
    rows, names = preaggregated_rows(df, data_extractors, public_partitions, partitions_sampling_prob, order=order)
    return rows.toDF(*names, "count", "sum", "n_partitions", "n_contributions")


def from_preaggregated(df: DataFrame, e: PreAggregateExtractors) -> tuple[DataFrame, list[str]]:
    """The same from rows that are pre-aggregated already: a struct column or four columns."""
    names = key_names(e.partition_extractor)
    keys = [k.alias(f"k{i}") for i, k in enumerate(columns(df, e.partition_extractor))]
    fields = ("count", "sum", "n_partitions", "n_contributions")
    found = [F.col(f"{e.preaggregate_extractor}.{f}").alias(f) for f in fields] if isinstance(e.preaggregate_extractor, str) else [c.alias(f) for c, f in zip(columns(df, e.preaggregate_extractor), fields)]
    return df.select(*keys, *found), names
