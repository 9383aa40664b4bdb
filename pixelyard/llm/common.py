"""Shared scratch tables, row keys and text helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of ``[\x20\x09-\x0D]``.
BLANK = " \t\n\x0b\x0c\r"

_left: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session that has none gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _delete_left() -> None:
    for spark, path in _left:
        with contextlib.suppress(Exception):  # the session may be gone
            delete(spark, path)


atexit.register(_delete_left)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a read and not a recomputation.

    ``release`` deletes a table that is no longer read. What a lazy result still reads stays until the
    driver's process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}
        self.written = 0
        _left.append((spark, self.root))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.root}/{name}-{self.written}"
        self.paths.setdefault(name, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                delete(self.spark, path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def row_key(*columns: Column) -> list[Column]:
    """128 bits that identify a row by its content, also where ids are null or repeated."""
    packed = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(0), *packed), F.xxhash64(F.lit(1), *packed)]


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns of the input whose names the operator gives to its own results."""
    return df.drop(*[c for c in names if c in df.columns])
