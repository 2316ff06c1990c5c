"""Budgets over windows: many units, payments of a repeated batch, the watermark's last half second."""

import datetime
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from hushframe import Budget
from hushframe.queries import ORACLES, QUERIES
from hushframe.streaming import stream_budgeted_counts
from hushframe.streaming.budgets import release_paid

from .oracle import compare

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, user long, kind string"


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def started(spark, tmp_path, max_per_key):
    return stream_budgeted_counts(
        spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "ts", "user", "kind", window="10 minutes", lateness="5 minutes", total_budget=Budget(1e12, 1e-2), max_windows=2, max_keys=2, max_per_key=max_per_key,
        public_keys=["a", "b"], sink=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), available_now=True,
    )


def released(spark, tmp_path):
    return {(int((r["begin"] - T0).total_seconds()) // 60, r["key"]): round(r["dp_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_many_units(spark, tmp_path):
    """30,000 units of four windows, each in a minute of its own and with two rows of a key."""
    minute = F.col("id") % 4 * 10 + F.floor(F.col("id") / 8) % 10
    rows = spark.range(240_000).select(F.timestamp_seconds(int(T0.replace(tzinfo=datetime.timezone.utc).timestamp()) + 60 * minute).alias("ts"), F.floor(F.col("id") / 8).alias("user"), F.when(F.col("id") % 4 == 1, "b").otherwise("a").alias("kind"))
    rows.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(T0 + datetime.timedelta(minutes=90), -1, "c")], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    q = started(spark, tmp_path, 9)
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    assert released(spark, tmp_path) == {(0, "a"): 60_000, (0, "b"): 0, (10, "a"): 0, (10, "b"): 60_000}


def test_payments_of_a_repeated_batch(spark, tmp_path):
    """A batch whose payments were written and whose release was lost pays the same again."""
    lost = []

    def release(kept):
        if lost:
            raise RuntimeError(lost.pop())
        return kept

    run = release_paid(release, str(tmp_path / "out"), str(tmp_path / "payments"), 2)
    batch = lambda *rows: spark.createDataFrame(rows, "begin long, unit long, key string, n long")
    seen = lambda: {(r["begin"], r["unit"], r["key"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    first = {(0, 1, "a", 5), (0, 1, "b", 1), (0, 2, None, 2)}
    run(batch(*first), 1)
    run(batch(), 2)
    assert seen() == first
    closed = batch((10, 1, "a", 1), (20, 1, "a", 1), (20, 2, "b", 3), (30, 2, "b", 4), (20, 3, "a", 1), (30, 3, "a", 1), (40, 3, "a", 1))
    second = first | {(10, 1, "a", 1), (20, 2, "b", 3), (20, 3, "a", 1), (30, 3, "a", 1)}
    lost.append("lost")
    with pytest.raises(RuntimeError):
        run(closed, 3)
    assert os.path.exists(tmp_path / "payments/number=3/_SUCCESS")
    for _ in range(2):
        run(closed, 3)
        assert seen() == second
    run(batch((50, 1, "a", 1), (50, 2, "a", 1), (50, 3, "a", 1), (50, 4, "a", 1)), 4)
    assert seen() == second | {(50, 4, "a", 1)}
    assert sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/payments/number=*")) == ["number=3", "number=4"]
    assert {(r["unit"], r["windows"]) for r in spark.read.parquet(f"{tmp_path}/payments/number=4").collect()} == {(1, 2), (2, 2), (3, 2), (4, 1)}


@pytest.mark.parametrize("last", ["00:59:59.7", "01:00:00"])
def test_the_watermark_is_not_rounded(spark, tmp_path, last):
    """The day that an hour's lateness closes only at one o'clock."""
    at = ["2024-01-01 12:00:00", "2024-01-02 12:00:00", "2024-01-02 23:59:59.7", f"2024-01-03 {last}"]
    rows = [(i, datetime.datetime.fromisoformat(t), i, "click", 1.0, "{}") for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    compare(spark, con, lambda session, _: QUERIES["stream_budgeted_days"](session, str(tmp_path)), ORACLES["stream_budgeted_days"])
