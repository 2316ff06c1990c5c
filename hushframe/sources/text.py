"""CSV and text files, plain and in sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header.  Without a schema the types are inferred by an extra pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_text(df: DataFrame, path: str) -> None:
    """One line a row: its columns joined by a comma."""
    df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.text(path)


def read_sectioned_text(spark: SparkSession, path: str, columns: list[str], section: str = "section", header: str = r"^\s*(\S+):\s*$") -> DataFrame:
    """Lines below a header line ("17:") as rows (section, *columns), split by commas.

    Files are read in splits.  Inside a split the header above a line is a running last
    value; a split that begins inside a section takes the header from the splits before
    it, of which only one row each takes part.
    """
    at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select("value", at[0].alias("file"), at[1].alias("begin"), F.monotonically_increasing_id().alias("n"))
    found: Column = F.regexp_extract("value", header, 1)
    lines = lines.withColumn("head", F.when(found != "", found))
    inside = Window.partitionBy("file", "begin").orderBy("n")
    lines = lines.withColumn("own", F.last("head", ignorenulls=True).over(inside))
    ends = lines.where("head is not null").groupBy("file", "begin").agg(F.max_by("head", "n").alias("ended"))
    splits = lines.select("file", "begin").distinct().join(ends, ["file", "begin"], "left")
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select("file", "begin", F.last("ended", ignorenulls=True).over(before).alias("carried"))
    rows = lines.join(carried, ["file", "begin"]).where("head is null").where(F.trim("value") != "")
    parts = F.split("value", ",")
    return rows.select(F.coalesce("own", "carried").alias(section), *[F.trim(F.get(parts, i)).alias(c) for i, c in enumerate(columns)])
