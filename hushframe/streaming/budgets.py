"""A privacy budget for each unit that lasts over all windows of a stream.

Spark's own streaming aggregation counts the rows of each (window, unit, key) and sends them
on when the watermark passes the window's end; rows behind it are late and never counted.
``foreachBatch`` ranks each unit's closed windows by their begin and adds those that it paid
for before: up to ``max_windows`` are released, the unit's rows of later ones are left out.
So a unit contributes to at most ``max_windows`` windows of a stream's life, and what all its
releases tell together is bounded by that many budgets of one window.

Payments are a table (unit, windows) beside the checkpoint's own folders, a version for each
batch that released something.  A batch's payments are written before its release, out of the
version before it: a batch that is repeated pays the same, and its release is written once
(``release_each_batch``), so nothing is spent twice.  No step runs Python for a unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..budget import Budget
from ..engine import delete_folder
from ..params import check_positive_int
from .windows import release_each_batch, release_windows, seconds


def placed_windows(stream: DataFrame, time: str, unit: str, key: str, window: str, lateness: str, placed: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(begin, unit, key, n) of tumbling windows that the watermark has closed.  ``placed``
    rounds the times by which rows fall into windows; the watermark goes by the times as they
    are, whose mark the windows' ends carry on."""
    length = 1000 * seconds(window)
    timed = stream.withWatermark(time, lateness)
    # whole windows from the epoch on, as milliseconds
    end = (F.floor(F.unix_millis(placed(F.col(time).cast("timestamp"))) / length) * length).cast("long") + length
    rows = timed.where(F.col(unit).isNotNull()).select(F.timestamp_millis(end).alias("end", metadata=timed.schema[time].metadata), F.col(unit).alias("unit"), F.col(key).cast("string").alias("key"))
    counted = rows.groupBy("end", "unit", "key").agg(F.count("*").alias("n"))
    return counted.select(F.timestamp_millis(F.unix_millis("end") - length).alias("begin"), "unit", "key", "n")


def payable(closed: DataFrame, paid: DataFrame | None, max_windows: int) -> DataFrame:
    """The rows of closed windows that their units can pay for after the windows that they
    have ``paid`` for, with ``rank``, the window's place among the unit's of this batch."""
    ranked = closed.withColumn("rank", F.dense_rank().over(Window.partitionBy("unit").orderBy("begin"))).where(F.col("rank") <= max_windows)
    if paid is None:
        return ranked
    return ranked.join(paid, "unit", "left").where(F.col("rank") + F.coalesce("windows", F.lit(0)) <= max_windows).drop("windows")


def _versions(spark: SparkSession, payments: str) -> list[int]:
    """The batches whose payments are whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(payments)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    whole = [name for name in found if name.startswith("number=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{payments}/{name}/_SUCCESS"))]
    return sorted(int(name.removeprefix("number=")) for name in whole)


def release_paid(release: Callable[[DataFrame], DataFrame], sink: str, payments: str, max_windows: int) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: of a batch's closed windows, those that their units can
    pay for are noted in ``payments`` and released to ``sink``."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in _versions(spark, payments) if n < number]
        paid = spark.read.parquet(f"{payments}/number={earlier[-1]}") if earlier else None

        def spend(kept: DataFrame) -> DataFrame:
            now = kept.groupBy("unit").agg(F.max("rank").cast("long").alias("windows"))
            total = now if paid is None else now.unionByName(paid).groupBy("unit").agg(F.sum("windows").alias("windows"))
            total.write.mode("overwrite").parquet(f"{payments}/number={number}")
            for n in earlier[:-1]:  # only the version before this batch may be read again
                delete_folder(spark, f"{payments}/number={n}")
            return release(kept.drop("rank"))

        release_each_batch(spend, sink, lambda closed: payable(closed, paid, max_windows))(batch, number)

    return run


def stream_budgeted_counts(
    stream: DataFrame, time: str, unit: str, key: str, *, window: str, lateness: str, total_budget: Budget, max_windows: int, max_keys: int, max_per_key: int, public_keys: DataFrame | Iterable[Any], sink: str, checkpoint: str, available_now: bool = False, placed: Callable[[Column], Column] = lambda c: c,
) -> StreamingQuery:
    """Start the query: every unit spends at most ``total_budget`` in the life of the stream,
    an equal share in each of ``max_windows`` windows.  Released windows are appended to the
    Parquet table ``sink``; payments lie in the checkpoint's folder.  The RocksDB state store
    keeps open windows out of the heap."""
    check_positive_int(max_windows, "max_windows")
    each = Budget(total_budget.epsilon / max_windows, total_budget.delta / max_windows)
    release = release_paid(lambda kept: release_windows(kept, each, max_keys, max_per_key, public_keys), sink, f"{checkpoint}/payments", max_windows)
    writer = placed_windows(stream, time, unit, key, window, lateness, placed).writeStream.outputMode("append").foreachBatch(release).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
