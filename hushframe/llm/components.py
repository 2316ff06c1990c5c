"""Connected components by alternating large and small stars on DataFrames.

Every step is a partial aggregation and an equi-join; its edges are written to the
shared folder, which cuts the lineage.  It ends when the edges themselves are stars:
every node has one link, and to a node that has none of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_windows import remove, work_dir


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
    least = both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"))
    return both.where("o > n").join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them (u > v holds)."""
    down = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("o"))
    least = down.groupBy("n").agg(F.min("o").alias("m"))
    joined = down.join(least, "n")
    return joined.select(F.col("o").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """(node, root) of every node of ``edges`` (u, v: long) but the roots themselves, with
    the component's smallest node as root; and the folder that holds the result.  Self
    links and repeated links are fine."""
    spark = edges.sparkSession
    path = path or work_dir(spark)
    edges.select("u", "v").where("u <> v").distinct().write.parquet(f"{path}/0")
    now, step = spark.read.parquet(f"{path}/0"), 0
    while True:
        step += 1
        _small(_large(now)).write.parquet(f"{path}/{step}")
        following = spark.read.parquet(f"{path}/{step}")
        # stars only: no node is both an end of one link and the root of another
        between = following.select("v").distinct().join(following.select(F.col("u").alias("v")), "v", "left_semi")
        several = following.groupBy("u").agg(F.count("*").alias("m")).where("m > 1").select("u")
        done = between.union(several).limit(1).count() == 0
        remove(spark, f"{path}/{step - 1}")
        now = following
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")), path
