"""Contribution bounding as ranked windows and partial aggregates.

Ranks are limited to small numbers, so Spark plans a group limit before the exchange:
of a hot unit or key only the rows that can be kept travel.

The order of a sample is a keyed hash: SipHash-2-4 (Aumasson and Bernstein, 2012) of the
SHA-256 of what a row is.  The key lies in the closure of an Arrow function, so neither plans
nor logs show it.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import AggregateParams


def _rotated(v: np.ndarray, by: int) -> np.ndarray:
    return (v << np.uint64(by)) | (v >> np.uint64(64 - by))


def siphash(words: np.ndarray, key: bytes) -> np.ndarray:
    """SipHash-2-4 of each row of 64-bit words (whole words only) under a key of 16 bytes."""
    k0, k1 = np.frombuffer(key, "<u8")
    # fixed values of the published function
    v0, v1, v2, v3 = (np.full(len(words), k ^ np.uint64(c)) for k, c in zip((k0, k1, k0, k1), (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)))
    last = np.full(len(words), (8 * words.shape[1] & 0xFF) << 56, np.uint64)
    for i, m in enumerate([*words.T, last, None]):
        if m is None:
            v2 ^= np.uint64(0xFF)
        else:
            v3 = v3 ^ m
        for _ in range(4 if m is None else 2):
            v0, v2 = v0 + v1, v2 + v3
            v1, v3 = _rotated(v1, 13) ^ v0, _rotated(v3, 16) ^ v2
            v0 = _rotated(v0, 32)
            v2, v0 = v2 + v1, v0 + v3
            v1, v3 = _rotated(v1, 17) ^ v2, _rotated(v3, 21) ^ v0
            v2 = _rotated(v2, 32)
        if m is not None:
            v0 = v0 ^ m
    return v0 ^ v1 ^ v2 ^ v3


def keyed_hash(secret: str, *columns: Column) -> Column:
    """A long that is random to who doesn't know the secret, and the same for equal columns."""
    key = bytes.fromhex(secret)[:16]

    def place(digests: pd.Series) -> pd.Series:
        words = np.frombuffer(b"".join(digests), "<u8").reshape(len(digests), -1)
        return pd.Series(siphash(words, key).view(np.int64))

    whole = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))
    return F.pandas_udf(place, "long")(F.unhex(F.sha2(whole.cast("binary"), 256)))


@dataclass(frozen=True)
class Sampling:
    """How contributions are sampled.  By default in order of a hash keyed by a ``secret`` of
    the system's entropy: uniform to who doesn't know it, and the same when a task is
    repeated in another order of rows, so a unit keeps what it kept before.  With a
    ``salt``, in order of md5(salt | row id), which anyone can repeat: for tests only."""

    salt: str | None = None
    row_id: Column | None = None
    secret: str = field(default_factory=lambda: os.urandom(16).hex(), repr=False)

    def numbered(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Equal rows numbered (``_copy``), so that each has a place of its own in the order.
        They are counted before anything is shuffled, and spread by their value."""
        if self.salt is not None:
            return rows
        counted = rows.groupBy("pid", *keys, "value").agg(F.count("*").alias("_n"))
        return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")

    def _keyed(self, *columns: Column) -> list[Column]:
        return [keyed_hash(self.secret, *columns)]

    def of_rows(self, keys: list[str]) -> list[Column]:
        if self.salt is None:
            return self._keyed(F.lit("rows"), *[F.col(c) for c in ("pid", *keys, "value", "_copy")])
        return [F.md5(F.concat(F.lit(f"{self.salt}1|"), F.col("row_id").cast("string"))), F.col("row_id")]

    def of_keys(self, keys: list[str]) -> list[Column]:
        if self.salt is None:
            return self._keyed(F.lit("keys"), F.col("pid"), *[F.col(k) for k in keys])
        parts = [c for k in ["pid", *keys] for c in (F.lit("|"), F.coalesce(F.col(k).cast("string"), F.lit("")))][1:]
        return [F.md5(F.concat(F.lit(f"{self.salt}2|"), *parts)), *[F.col(k) for k in keys]]


def sample(df: DataFrame, group: list[str], most: int, order: list[Column]) -> DataFrame:
    """At most ``most`` rows of every group."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def bound(rows: DataFrame, keys: list[str], p: AggregateParams, partials: list[Column], sampled: bool, sampling: Sampling, counted: bool = False, few_keys: bool = False) -> tuple[DataFrame, list[str]]:
    """One row of ``partials`` for each kept (pid, key), and report stages.  Where rows are only
    ``counted``, those of a unit in a partition are told by their number, so none is drawn: the
    caller's ``partials`` cut it off.  With ``few_keys`` there are at most as many keys as a unit
    may have, and none has to go."""
    # the labels before each colon are fixed values of a report
    by_rows, by_keys = sampling.of_rows(keys), sampling.of_keys(keys)
    if p.max_contributions is not None or sampled and not counted:
        rows = sampling.numbered(rows, keys)
    unit = ["pid", *keys]
    stages = []
    if p.max_contributions is not None:
        rows = sample(rows, ["pid"], p.max_contributions, by_rows)
        stages.append(f"User contribution bounding: a random sample of at most {p.max_contributions} rows of each privacy id")
        return rows.groupBy(*unit).agg(*partials), stages
    if sampled:
        if not counted:
            rows = sample(rows, unit, p.max_contributions_per_partition, by_rows)
        stages.append(f"Per-partition contribution bounding: a random sample of at most {p.max_contributions_per_partition} rows of each privacy id in each partition")
    out = rows.groupBy(*unit).agg(*partials)
    if p.perform_cross_partition_contribution_bounding:
        if not few_keys:
            out = sample(out, ["pid"], p.max_partitions_contributed, by_keys)
        stages.append(f"Cross-partition contribution bounding: a random sample of at most {p.max_partitions_contributed} partitions of each privacy id")
    return out, stages
