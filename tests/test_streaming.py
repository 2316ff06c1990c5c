"""Windows of streams and batches, sessions, and budgets that last over windows."""

import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from hushframe import Budget, NoiseKind
from hushframe.streaming import release_sessions, release_windows, session_counts, stream_budgeted_counts, stream_dp_counts, window_counts
from hushframe.streaming.windows import overlap, release_each_batch, seconds

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, user long, kind string"
BIG = Budget(1e9, 1e-2)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def shared(spark):
    """Folders of releases under the shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return set(glob.glob(f"{root.removeprefix('file:')}/release-*")) if root else set()


def test_durations():
    assert (seconds("10 minutes"), seconds("1 day"), overlap("1 hour", None), overlap("1 hour", "25 minutes")) == (600, 86_400, 1, 3)
    with pytest.raises(ValueError):
        seconds("2 moons")


def plain_windows(rows, size, slide):
    found = {}
    for t, u, k in rows:
        m = int((t - T0).total_seconds()) // 60
        first = m // slide * slide
        for begin in range(first, m - size, -slide):
            found[begin, u, k] = found.get((begin, u, k), 0) + 1
    return found


@pytest.mark.parametrize("size,slide", [(10, None), (30, 10), (25, 10)])
def test_windows_of_a_batch(spark, size, slide):
    r = random.Random(size)
    rows = [(at(r.randrange(200)), r.choice([1, 2, 3, None]), r.choice(["a", "b", None])) for _ in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = window_counts(df, "ts", "user", "kind", f"{size} minutes", f"{slide} minutes" if slide else None)
    got = {((x["begin"] - T0).total_seconds() // 60, x["unit"], x["key"]): x["n"] for x in counts.collect()}
    expected = plain_windows(rows, size, slide or size)
    assert got == expected
    released = release_windows(counts, BIG, 2, 4, ["a", "none"], windows_of_a_row=overlap(f"{size} minutes", f"{slide} minutes" if slide else None)).collect()
    begins = {b for b, _, _ in expected}
    assert len(released) == 2 * len(begins)
    for x in released:
        b = (x["begin"] - T0).total_seconds() // 60
        assert round(x["dp_count"]) == sum(min(n, 4) for (w, u, k), n in expected.items() if (w, k) == (b, x["key"]) and u is not None)
    assert release_windows(counts.where("false"), BIG, 2, 4, ["a"]).collect() == []


def test_overlapping_windows_share_a_budget(spark):
    """Deviation of the noise: three times that of one window for three that overlap."""
    counts = spark.createDataFrame([(at(i), 1, "a", 0) for i in range(800)], "begin timestamp, unit long, key string, n long")
    spread = [release_windows(counts, Budget(1, 1e-6), 1, 1, ["a"], NoiseKind.LAPLACE, k).agg(F.stddev("dp_count")).first()[0] for k in (1, 3)]
    assert 2.2 < spread[1] / spread[0] < 4.0


def test_sessions(spark):
    r = random.Random(3)
    rows = [(at(r.randrange(3000)), r.randrange(6), r.choice("ab")) for _ in range(400)]
    found = session_counts(spark.createDataFrame(rows, SCHEMA), "ts", "user", "kind", "20 minutes")
    expected = []
    for u in range(6):
        for k in "ab":
            times = sorted(t for t, x, y in rows if (x, y) == (u, k))
            for i, t in enumerate(times):
                if i and t - times[i - 1] <= datetime.timedelta(minutes=20):
                    expected[-1][1:] = [t + datetime.timedelta(minutes=20), u, k, expected[-1][4] + 1]
                else:
                    expected.append([t, t + datetime.timedelta(minutes=20), u, k, 1])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected))
    released = release_sessions(found, lambda c: F.date_trunc("day", c), BIG, 1000, ["a", "b", "c"], max_rows=100).collect()
    for x in released:
        own = [s for s in expected if s[0].date() == x["period"].date() and s[3] == x["key"]]
        assert (round(x["dp_sessions"]), round(x["dp_rows"])) == (len(own), sum(s[4] for s in own))
    assert {x["key"] for x in released} == {"a", "b", "c"}
    # a unit's sessions of a day are bounded together
    total = sum(round(x["dp_sessions"]) for x in release_sessions(found, lambda c: F.date_trunc("day", c), BIG, 2, ["a", "b"], max_rows=100).collect())
    assert total == sum(min(2, n) for n in {(s[0].date(), s[2]): sum((y[0].date(), y[2]) == (s[0].date(), s[2]) for y in expected) for s in expected}.values())


def test_sliding_stream(spark, tmp_path):
    """Windows that overlap are released once each, and no folder of a release stays."""
    rows = [(at(m), u, k) for u in range(20) for m, k in ((1, "a"), (12, "a"), (13, "b"), (55, "b"))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = shared(spark)
    for _ in range(2):  # the second run has nothing new
        q = stream_dp_counts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "ts", "user", "kind", window="20 minutes", slide="10 minutes", lateness="5 minutes", budget=BIG, max_keys=2, max_per_key=5, public_keys=["a", "b"], sink=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), available_now=True)
        q.awaitTermination(120)
    got = {((r["begin"] - T0).total_seconds() // 60, r["key"]): round(r["dp_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(-10, "a"): 20, (-10, "b"): 0, (0, "a"): 40, (0, "b"): 20, (10, "a"): 20, (10, "b"): 20}
    assert shared(spark) == before


def test_failed_release_is_repeated_and_whole_ones_are_not(spark, tmp_path):
    calls = []

    def release(batch):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return batch

    df, run = spark.range(3), release_each_batch(release, str(tmp_path / "out"))
    with pytest.raises(RuntimeError):
        run(df, 0)
    run(df, 0)
    run(df, 0)
    assert len(calls) == 2 and spark.read.parquet(str(tmp_path / "out")).count() == 3


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_budgets_over_windows(spark, rocks, tmp_path):
    """Units pay for two windows; a restart goes on, a repeated batch spends nothing twice, and
    late rows count nowhere."""
    source, sink, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def go():
        q = stream_budgeted_counts(spark.readStream.schema(SCHEMA).parquet(source), "ts", "user", "kind", window="10 minutes", lateness="5 minutes", total_budget=BIG, max_windows=2, max_keys=2, max_per_key=9, public_keys=["a", "b"], sink=sink, checkpoint=checkpoint, available_now=True)
        q.awaitTermination(180)
        assert q.exception() is None
        return {((r["begin"] - T0).total_seconds() // 60, r["key"]): round(r["dp_count"]) for r in spark.read.parquet(sink).collect()}

    feed([(at(1), 1, "a"), (at(2), 1, "a"), (at(3), 2, "b"), (at(11), 1, "a"), (at(12), None, "a"), (at(28), 3, "a")])
    first = go()
    assert first == {(0, "a"): 2, (0, "b"): 1, (10, "a"): 1, (10, "b"): 0}
    # unit 1 has paid for two windows; unit 3's window is still open; minute 4 is late
    feed([(at(4), 2, "a"), (at(27), 1, "b"), (at(29), 2, "b"), (at(44), 3, "b"), (at(60), 4, "a")])
    second = go()
    assert second == {**first, (20, "a"): 1, (20, "b"): 1, (40, "a"): 0, (40, "b"): 1}
    files = sorted(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    for path in (files[-1], os.path.join(os.path.dirname(files[-1]), f".{os.path.basename(files[-1])}.crc")):
        if os.path.exists(path):
            os.remove(path)  # as if the driver had died before the batch was committed
    assert go() == second
    # units 2 and 3 have paid for two windows each by now, unit 4 for none
    feed([(at(61), 2, "a"), (at(62), 3, "a"), (at(63), 4, "b"), (at(90), 5, "a")])
    assert go() == {**second, (60, "a"): 1, (60, "b"): 1}
