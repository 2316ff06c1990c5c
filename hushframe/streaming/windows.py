"""DP counts by key in event-time windows: tumbling, sliding and session windows.

The stream keeps one count for each (window, privacy unit, key).  When the watermark
closes a window its counts go to ``foreachBatch``, where one batch aggregation bounds
each unit's keys, adds noise and appends the window's rows to a table.  A window is
released once, so its budget is spent once; units may contribute to every window.

A row lies in several sliding windows, so each of them gets that part of the budget: what
one slide's length of a unit's rows can tell stays within the whole.  Sessions are windows
of a unit's own; they are counted by key and by the period that they begin in, and a unit
has at most ``max_sessions`` of them there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..budget import Budget, NaiveBudgetAccountant
from ..engine import BROADCAST_KEYS, DPEngine, released_folders
from ..extractors import DataExtractors
from ..params import AggregateParams, Metrics, NoiseKind, require

#: Seconds of the units that a window's length may be told in.
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def seconds(duration: str) -> int:
    """Seconds of a duration such as "10 minutes"."""
    number, unit = duration.split()
    unit = unit.lower().rstrip("s")
    require(unit in _SECONDS, f"a duration is a number of {', '.join(_SECONDS)}s")
    return int(number) * _SECONDS[unit]


def overlap(window: str, slide: str | None) -> int:
    """Windows that one moment lies in, at most."""
    return 1 if slide is None else math.ceil(seconds(window) / seconds(slide))


def window_counts(rows: DataFrame, time: str, unit: str, key: str, window: str, slide: str | None = None) -> DataFrame:
    """(begin, unit, key, n) by tumbling windows, or sliding ones with ``slide``."""
    of = F.window(time, window, slide) if slide else F.window(time, window)
    counted = rows.groupBy(of.alias("w"), F.col(unit).alias("unit"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("begin"), "unit", "key", "n")


def session_counts(rows: DataFrame, time: str, unit: str, key: str, gap: str) -> DataFrame:
    """(begin, end, unit, key, n): sessions of a unit with a key, which a pause of more than
    ``gap`` ends."""
    counted = rows.groupBy(F.session_window(time, gap).alias("w"), F.col(unit).alias("unit"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "unit", "key", "n")


def closed_windows(stream: DataFrame, time: str, unit: str, key: str, window: str, lateness: str, slide: str | None = None) -> DataFrame:
    """(begin, unit, key, n) of windows that the watermark has closed."""
    return window_counts(stream.withWatermark(time, lateness), time, unit, key, window, slide)


def _keys_of(spark: Any, public_keys: DataFrame | Iterable[Any], like: T.DataType) -> DataFrame:
    if isinstance(public_keys, DataFrame):
        return public_keys.toDF("key").distinct()
    return spark.createDataFrame([(k,) for k in public_keys], T.StructType([T.StructField("key", like)])).distinct()


def each_window(public: DataFrame, counts: DataFrame) -> DataFrame:
    """(begin, key): every public key of every window; the windows are broadcast if few."""
    begins = counts.select("begin").distinct()
    few = begins.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return public.crossJoin(F.broadcast(begins) if few else begins).select("begin", "key")


def release_windows(
    counts: DataFrame, budget: Budget, max_keys: int, max_per_key: int, public_keys: DataFrame | Iterable[Any], noise: NoiseKind = NoiseKind.LAPLACE, windows_of_a_row: int = 1,
) -> DataFrame:
    """(begin, key, dp_count) of closed windows: every public key of every window.  Of
    overlapping windows each spends ``budget / windows_of_a_row``."""
    public = _keys_of(counts.sparkSession, public_keys, counts.schema["key"].dataType)
    accountant = NaiveBudgetAccountant(budget.epsilon / windows_of_a_row, budget.delta / windows_of_a_row)
    params = AggregateParams(metrics=[Metrics.SUM], noise_kind=noise, max_partitions_contributed=max_keys, max_contributions_per_partition=1, min_sum_per_partition=0, max_sum_per_partition=max_per_key)
    extractors = DataExtractors(F.struct("unit", "begin"), ["begin", "key"], "n")
    result = DPEngine(accountant).aggregate(counts.where("unit is not null"), params, extractors, each_window(public, counts))
    accountant.compute_budgets()
    return result.to_df().withColumnRenamed("sum", "dp_count")


def release_sessions(sessions: DataFrame, period: Callable[[Column], Column], budget: Budget, max_sessions: int, public_keys: DataFrame | Iterable[Any], noise: NoiseKind = NoiseKind.LAPLACE, max_rows: int = 1) -> DataFrame:
    """(period, key, dp_sessions, dp_rows): sessions by key and ``period`` of their begin, and
    their rows.  A unit has at most ``max_sessions`` of a period, of ``max_rows`` rows each."""
    placed = sessions.where("unit is not null").select(period(F.col("begin")).alias("begin"), "unit", "key", F.col("n").cast("double").alias("n"))
    public = _keys_of(sessions.sparkSession, public_keys, sessions.schema["key"].dataType)
    accountant = NaiveBudgetAccountant(budget.epsilon, budget.delta)
    params = AggregateParams(metrics=[Metrics.COUNT, Metrics.SUM], noise_kind=noise, max_contributions=max_sessions, min_value=0, max_value=max_rows)
    result = DPEngine(accountant).aggregate(placed, params, DataExtractors(F.struct("unit", "begin"), ["begin", "key"], "n"), each_window(public, placed))
    accountant.compute_budgets()
    return result.to_df().withColumnsRenamed({"begin": "period", "count": "dp_sessions", "sum": "dp_rows"})


def release_each_batch(release: Callable[[DataFrame], DataFrame], sink: str, of: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that appends the release of a batch, or of its rows
    ``of``, to the table ``sink`` once: a batch that is repeated after its release was whole draws nothing again, and the
    folders that a release reads from go when it is written."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/number={number}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            batch.write.format("noop").mode("append").save()  # the stream's state still has to move on
            return
        held = of(batch).persist()
        try:
            if not held.isEmpty():
                with released_folders(spark):
                    # what a failed attempt left is overwritten, as no one was told it was whole
                    release(held).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/number={number}")
        finally:
            held.unpersist()

    return run


def stream_dp_counts(
    stream: DataFrame, time: str, unit: str, key: str, *, window: str, lateness: str, budget: Budget, max_keys: int, max_per_key: int, public_keys: DataFrame | Iterable[Any], sink: str, checkpoint: str, available_now: bool = False, slide: str | None = None,
) -> StreamingQuery:
    """Start the query; released windows are appended to the Parquet table ``sink``."""
    release = release_each_batch(lambda held: release_windows(held, budget, max_keys, max_per_key, public_keys, windows_of_a_row=overlap(window, slide)), sink)
    writer = closed_windows(stream, time, unit, key, window, lateness, slide).writeStream.outputMode("append").foreachBatch(release).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
