"""How a dataset's partitions and a public list overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class PublicPartitionsSummary:
    num_dataset_public_partitions: int
    num_dataset_non_public_partitions: int
    num_empty_public_partitions: int


def public_partitions_counts(df: DataFrame, keys: list[str], public: DataFrame) -> DataFrame:
    """One row of the three counts, from a full outer join of distinct keys."""
    own = df.select(*keys).distinct().withColumn("_own", F.lit(1)).alias("a")
    listed = public.toDF(*keys).distinct().withColumn("_listed", F.lit(1)).alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = own.join(listed, on, "full_outer")
    return both.agg(
        F.count_if(F.col("_own").isNotNull() & F.col("_listed").isNotNull()).alias("num_dataset_public_partitions"),
        F.count_if(F.col("_listed").isNull()).alias("num_dataset_non_public_partitions"),
        F.count_if(F.col("_own").isNull()).alias("num_empty_public_partitions"),
    )


def compute_public_partitions_summary(df: DataFrame, keys: list[str], public: DataFrame) -> PublicPartitionsSummary:
    return PublicPartitionsSummary(*public_partitions_counts(df, keys, public).first())
