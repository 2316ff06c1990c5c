"""Contribution histograms of a dataset, as grouped counts that are binned and grouped.

Bins are made by SQL expressions; only the bins (thousands at most, whatever the data)
come to the driver.  Integer histograms keep three leading digits, sum histograms either
have 10,000 equal bins between the extremes or keep two leading digits.
"""

from __future__ import annotations

import enum
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: equal bins of a linear histogram.
LINEAR_BINS = 10_000


@dataclass
class FrequencyBin:
    """Values of [lower, upper): how many, their sum, and the extremes."""

    lower: float
    upper: float
    count: int
    sum: float
    max: float
    min: float | None = None


class HistogramType(enum.Enum):
    L0_CONTRIBUTIONS = "l0_contributions"
    L1_CONTRIBUTIONS = "l1_contributions"
    LINF_CONTRIBUTIONS = "linf_contributions"
    LINF_SUM_CONTRIBUTIONS = "linf_sum_contributions"
    LINF_SUM_CONTRIBUTIONS_LOG = "linf_sum_contributions_log"
    COUNT_PER_PARTITION = "count_per_partition"
    COUNT_PRIVACY_ID_PER_PARTITION = "privacy_id_per_partition_count"
    SUM_PER_PARTITION = "sum_per_partition"
    SUM_PER_PARTITION_LOG = "sum_per_partition_log"


@dataclass
class Histogram:
    name: HistogramType
    bins: list[FrequencyBin]

    def total_count(self) -> float:
        return sum(b.count for b in self.bins)

    def total_sum(self) -> float:
        return sum(b.sum for b in self.bins)

    @property
    def is_integer(self) -> bool:
        return "sum" not in self.name.value

    @property
    def lower(self) -> float:
        return 1 if self.is_integer else (self.bins[0].lower if self.bins else 0)

    @property
    def upper(self) -> float | None:
        return None if self.is_integer or not self.bins else self.bins[-1].upper

    def max_value(self) -> float:
        return self.bins[-1].max

    def quantiles(self, q: Sequence[float]) -> list[float]:
        """For each q the lower bound of the last bin below which at most q of the values lie."""
        counts = np.array([b.count for b in self.bins], float)
        below = np.concatenate([[0.0], np.cumsum(counts)[:-1]]) / counts.sum()
        return [self.bins[max(0, int(np.searchsorted(below, x, "right")) - 1)].lower for x in q]


@dataclass
class DatasetHistograms:
    l0_contributions_histogram: Histogram
    l1_contributions_histogram: Histogram
    linf_contributions_histogram: Histogram
    linf_sum_contributions_histogram: Histogram | list[Histogram] | None
    linf_sum_contributions_histogram_log: Histogram | list[Histogram] | None
    count_per_partition_histogram: Histogram
    count_privacy_id_per_partition: Histogram
    sum_per_partition_histogram: Histogram | list[Histogram] | None
    sum_per_partition_histogram_log: Histogram | list[Histogram] | None


def exact_sum(v: Column) -> Column:
    """A double: the sum of doubles, rounded once, so that no order of rows moves a sum over a
    bin's edge.  It adds them as decimals of 18 places; where those don't hold a value or the
    sum (large, tiny, infinite or NaN) it is the sum of doubles."""
    v = v.cast("double")
    held = v.try_cast("decimal(38,18)")
    lost = F.count(F.when(v.isNotNull() & ~F.coalesce(held.cast("double") == v, F.lit(False)), 1))
    return F.coalesce(F.when(lost == 0, F.try_sum(held).cast("double")), F.sum(v))


def sums_in_order(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, v, s): each group's rows and the sum of their values, added one by one as doubles in
    the order of the column ``order``, as one thread of SQL adds them.  The running frames
    spill, so a group may have any size."""
    w = Window.partitionBy(*by).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select(*by, F.count("*").over(so_far).alias("v"), F.sum("value").over(so_far).alias("s"), F.lead(F.lit(1)).over(w).alias("_next"))
    return running.where("_next is null").select(*by, "v", "s")


def integer_bin(v: Column) -> tuple[Column, Column]:
    """Lower and upper bound of three leading digits."""
    digits = F.length(v.cast("long").cast("string"))
    base = F.pow(F.lit(10.0), F.greatest(digits - 3, F.lit(0))).cast("long")
    lower = F.floor(v / base).cast("long") * base
    return lower, lower + base


def log_bin(v: Column) -> tuple[Column, Column]:
    """Bounds of two leading digits; negative values mirror positive ones; 0 is a bin."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))) - 1)
    low = F.floor(F.abs(v) / scale) * scale
    high = (F.floor(F.abs(v) / scale) + 1) * scale
    return F.when(v == 0, F.lit(0.0)).when(v > 0, low).otherwise(-high), F.when(v == 0, F.lit(0.0)).when(v > 0, high).otherwise(-low)


def linear_bin(v: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds among ``LINEAR_BINS`` equal bins of [low, high]; the last one is closed."""
    step = (high - low) / LINEAR_BINS
    i = F.least(F.floor((v - low) / step), F.lit(LINEAR_BINS - 1))
    return F.when(low == high, low).otherwise(low + i * step), F.when(low == high, high).otherwise(low + (i + 1) * step)


def binned(values: DataFrame, v: str, lower: Column, upper: Column, weight: Column | None = None) -> DataFrame:
    """(lower, upper, count, sum, min, max) of the bins, two partial aggregations."""
    count = F.count("*") if weight is None else F.round(F.sum(weight)).cast("long")
    total = F.sum(v) if weight is None else F.round(F.sum(F.col(v) * weight)).cast("long")
    return values.withColumn("lower", lower).withColumn("upper", upper).groupBy("lower", "upper").agg(count.alias("count"), total.alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))


def collected(bins: DataFrame) -> list[FrequencyBin]:
    rows = bins.orderBy("lower", "upper").collect()
    return [FrequencyBin(r["lower"], r["upper"], r["count"], r["sum"], r["max"], r["min"]) for r in rows]


def frequency_bins(values: DataFrame, v: str) -> list[FrequencyBin]:
    return collected(integer_histogram(values, v))


def integer_histogram(values: DataFrame, v: str, weight: Column | None = None) -> DataFrame:
    lower, upper = integer_bin(F.col(v))
    return binned(values, v, lower, upper, weight)


def log_histogram(values: DataFrame, v: str) -> DataFrame:
    lower, upper = log_bin(F.col(v))
    return binned(values, v, lower, upper)


def linear_histogram(values: DataFrame, v: str) -> DataFrame:
    """The extremes are a one-row side input."""
    ends = values.agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    with_ends = values.crossJoin(F.broadcast(ends))  # one row
    lower, upper = linear_bin(F.col(v), F.col("_low"), F.col("_high"))
    return binned(with_ends, v, lower, upper)


class Counts:
    """Grouped counts behind the histograms, from rows (pid, k0, ..., value[, row_id]); with
    ``row_id`` a pair's values are added as doubles in its order."""

    def __init__(self, rows: DataFrame, keys: list[str]):
        self.rows, self.keys = rows, keys
        if "row_id" in rows.columns:
            self.pairs = sums_in_order(rows, ["pid", *keys], "row_id")
            return
        self.pairs = rows.groupBy("pid", *keys).agg(F.count("*").alias("v"), exact_sum(F.col("value")).alias("s") if rows.schema["value"].dataType.typeName() != "array" else F.lit(None).cast("double").alias("s"))

    def l0(self) -> DataFrame:
        return integer_histogram(self.pairs.groupBy("pid").agg(F.count("*").alias("n")), "n")

    def l1(self) -> DataFrame:
        return integer_histogram(self.rows.groupBy("pid").agg(F.count("*").alias("n")), "n")

    def linf(self) -> DataFrame:
        return integer_histogram(self.pairs, "v")

    def count_per_partition(self) -> DataFrame:
        return integer_histogram(self.rows.groupBy(*self.keys).agg(F.count("*").alias("n")), "n")

    def units_per_partition(self) -> DataFrame:
        return integer_histogram(self.pairs.groupBy(*self.keys).agg(F.count("*").alias("n")), "n")

    def linf_sum(self, log: bool = False) -> DataFrame:
        return (log_histogram if log else linear_histogram)(self.pairs.select("s"), "s")

    def sum_per_partition(self, log: bool = False) -> DataFrame:
        return (log_histogram if log else linear_histogram)(self.pairs.groupBy(*self.keys).agg(exact_sum(F.col("s")).alias("s")).select("s"), "s")


class PairCounts(Counts):
    """The same from one row for each (pid, k0, ...), with its count ``v`` and a sum."""

    def __init__(self, pairs: DataFrame, keys: list[str], total: str):
        self.keys, self.pairs = keys, pairs.select("pid", *keys, "v", F.col(total).alias("s"))

    def l1(self) -> DataFrame:
        return integer_histogram(self.pairs.groupBy("pid").agg(F.sum("v").alias("n")), "n")

    def count_per_partition(self) -> DataFrame:
        return integer_histogram(self.pairs.groupBy(*self.keys).agg(F.sum("v").alias("n")), "n")


class PreaggregatedCounts:
    """The same from pre-aggregated rows (k0, ..., count, sum, n_partitions, n_contributions);
    a unit shows up n_partitions times, so it weighs 1 / n_partitions."""

    def __init__(self, rows: DataFrame, keys: list[str]):
        self.rows, self.keys = rows.withColumn("v", F.col("count")).withColumn("s", F.col("sum").cast("double")), keys

    def l0(self) -> DataFrame:
        return integer_histogram(self.rows, "n_partitions", 1 / F.col("n_partitions"))

    def l1(self) -> DataFrame:
        return integer_histogram(self.rows, "n_contributions", 1 / F.col("n_partitions"))

    def linf(self) -> DataFrame:
        return integer_histogram(self.rows, "v")

    def count_per_partition(self) -> DataFrame:
        return integer_histogram(self.rows.groupBy(*self.keys).agg(F.sum("v").alias("n")), "n")

    def units_per_partition(self) -> DataFrame:
        return integer_histogram(self.rows.groupBy(*self.keys).agg(F.count("*").alias("n")), "n")

    def linf_sum(self, log: bool = False) -> DataFrame:
        return (log_histogram if log else linear_histogram)(self.rows.select("s"), "s")

    def sum_per_partition(self, log: bool = False) -> DataFrame:
        return (log_histogram if log else linear_histogram)(self.rows.groupBy(*self.keys).agg(exact_sum(F.col("s")).alias("s")).select("s"), "s")


def _all(counts: Counts | PreaggregatedCounts, has_sums: bool) -> DatasetHistograms:
    t = HistogramType
    made = lambda kind, df: Histogram(kind, collected(df))
    return DatasetHistograms(
        made(t.L0_CONTRIBUTIONS, counts.l0()), made(t.L1_CONTRIBUTIONS, counts.l1()), made(t.LINF_CONTRIBUTIONS, counts.linf()),
        made(t.LINF_SUM_CONTRIBUTIONS, counts.linf_sum()) if has_sums else None, made(t.LINF_SUM_CONTRIBUTIONS_LOG, counts.linf_sum(True)) if has_sums else None,
        made(t.COUNT_PER_PARTITION, counts.count_per_partition()), made(t.COUNT_PRIVACY_ID_PER_PARTITION, counts.units_per_partition()),
        made(t.SUM_PER_PARTITION, counts.sum_per_partition()) if has_sums else None, made(t.SUM_PER_PARTITION_LOG, counts.sum_per_partition(True)) if has_sums else None,
    )


def compute_dataset_histograms(df: DataFrame, data_extractors) -> DatasetHistograms:
    """All histograms; with several value columns the sum histograms are lists."""
    from ..extractors import extract

    rows, names = extract(df, data_extractors)
    keys = [f"k{i}" for i in range(len(names))]
    if rows.schema["value"].dataType.typeName() != "array":
        return _all(Counts(rows, keys), True)
    # one aggregation of the rows for all columns; its groups are held on disk meanwhile
    width = len(data_extractors.value_extractor)
    pairs = rows.groupBy("pid", *keys).agg(F.count("*").alias("v"), *[exact_sum(F.get("value", i)).alias(f"s{i}") for i in range(width)]).persist(StorageLevel.DISK_ONLY)
    try:
        out = _all(PairCounts(pairs, keys, "s0"), True)
        each = [PairCounts(pairs, keys, f"s{i}") for i in range(width)]
        t = HistogramType
        for name, kind, bins in (
            ("linf_sum_contributions_histogram", t.LINF_SUM_CONTRIBUTIONS, lambda c: c.linf_sum()), ("linf_sum_contributions_histogram_log", t.LINF_SUM_CONTRIBUTIONS_LOG, lambda c: c.linf_sum(True)),
            ("sum_per_partition_histogram", t.SUM_PER_PARTITION, lambda c: c.sum_per_partition()), ("sum_per_partition_histogram_log", t.SUM_PER_PARTITION_LOG, lambda c: c.sum_per_partition(True)),
        ):
            setattr(out, name, [getattr(out, name), *[Histogram(kind, collected(bins(c))) for c in each[1:]]])
    finally:
        pairs.unpersist()
    return out


def compute_dataset_histograms_on_preaggregated_data(df: DataFrame, keys: list[str]) -> DatasetHistograms:
    return _all(PreaggregatedCounts(df, keys), True)


def compute_ratio_dropped(histogram: Histogram) -> list[tuple[float, float]]:
    """(bound, share of the data that it drops) for every bin's lower bound and the maximum."""
    if not histogram.bins:
        return []
    total = histogram.total_sum()
    bins, out = histogram.bins, []
    above_sum, above_count = 0.0, 0.0
    last = histogram.max_value()
    if bins[-1].lower != last:
        out.append((last, 0.0))
    for b in reversed(bins):
        above_sum, above_count = above_sum + b.sum, above_count + b.count
        out.append((b.lower, (above_sum - above_count * b.lower) / total))
    out.append((0, 1.0))
    return out[::-1]
