"""Deterministic value sampling and joins on hot keys."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValueSampler:
    """Keeps a value if the first 64 bits of sha1(repr(value)) are below the rate."""

    def __init__(self, sampling_probability: float):
        self.bound = round(sampling_probability * 2**64)

    def keep(self, value: Any) -> bool:
        return int(hashlib.sha1(repr(value).encode()).hexdigest()[:16], 16) < self.bound

    def condition(self, value: Column, text: bool = False) -> Column:
        """The same in SQL for integers, or with ``text`` for strings without quotes or
        backslashes."""
        shown = F.concat(F.lit("'"), value, F.lit("'")) if text else value.cast("string")
        head = F.conv(F.substring(F.sha1(shown), 1, 16), 16, 10).cast("decimal(20,0)")
        return head < F.lit(str(self.bound)).cast("decimal(20,0)")


def filter_by_key_with_sharding(df: DataFrame, keys: DataFrame, key: str, shards: int) -> DataFrame:
    """Semi-join on a key with hot values: rows get a shard by the hash of all their columns,
    which a repeated task finds again, and keys get all shards."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salted = df.withColumn("_shard", F.pmod(F.xxhash64(*hashed), F.lit(shards)).cast("int"))
    listed = keys.select(F.col(key)).distinct().withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return salted.join(listed, [key, "_shard"], "left_semi").drop("_shard")


def min_max_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def size(df: DataFrame) -> DataFrame:
    """One row with the number of rows; no row for an empty frame."""
    return df.agg(F.count("*").alias("size")).where("size > 0")
