"""Every registered query of the DP engine against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from hushframe.queries import ORACLES, QUERIES

from .oracle import SF, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        compare(spark, con, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def heavy(spark, tmp_path_factory):
    """Tables in which one unit has over 500 rows in a group."""
    root = tmp_path_factory.mktemp("heavy")
    con = duckdb.connect()
    for name, unit, group in (("events", "user_id", "event_type = 'click'"), ("orders", "o_custkey", "o_orderstatus = 'O'")):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        one = df.where(group).limit(1500).withColumn(unit, F.lit(1).cast(df.schema[unit].dataType))
        df.limit(2000).union(one).write.parquet(f"{root}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet/*.parquet')")
    return str(root), con


@pytest.mark.parametrize("name", ["dp_count_public", "dp_sum_public", "dp_mean_public", "dp_variance_public", "dp_count_private_selection", "dp_public_fill_empty", "private_frame_count", "dp_multi_key_groupby"])
def test_heavy_unit(spark, heavy, name):
    """No row that the SQL counts is dropped."""
    root, con = heavy
    compare(spark, con, lambda session, _: QUERIES[name](session, root), ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["event_type", "dp_count", "dp_sum"] and df.count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
