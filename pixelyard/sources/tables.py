"""Plain tables: the parquet inputs and the partitioned output layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pixelyard.sources.publish import current, publish


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("bucket", "format"), mode: str = "errorifexists") -> None:
    """Parquet in ``<by[0]>=.../<by[1]>=...`` folders, committed all or nothing.

    The rebalance hint lets adaptive execution merge small partitions and split hot ones, so a
    folder gets few files and a dominant value is still written by many tasks.
    """
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def publish_table(df: DataFrame, path: str, by: Sequence[str] = ("bucket", "format")) -> str:
    """``write_table`` into a version of its own that readers see once it is whole; returns its folder."""
    return publish(df.sparkSession, path, lambda folder: write_table(df, folder, by))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``publish_table`` finished last."""
    return spark.read.parquet(current(spark, path))
