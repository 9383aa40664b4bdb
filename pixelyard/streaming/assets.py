"""New files of a folder, admitted and estimated as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pixelyard import constants as K
from pixelyard.plans.assets import estimate_assets
from pixelyard.sources.files import ANNOUNCED, BINARY_FILE, read_named


def asset_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000, max_file_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """New files; those above the size limit come without their content, which is then never read.

    Both kinds read one source, so a batch's files are listed once. Spark plans a partition for every 32 small files;
    they are put together to as many tasks as there are cores, each of which writes one file of a sink. Spark keeps
    every file it has seen, and those of a batch, in the driver; ``announced_stream`` is for millions of files."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_trigger)
    files = reader.option("recursiveFileLookup", "true").load(folder)
    small = files.where(F.col("length") <= max_file_bytes)
    large = files.where(F.col("length") > max_file_bytes).withColumn("content", F.lit(None).cast("binary"))
    return small.unionByName(large).coalesce(max(1, spark.sparkContext.defaultParallelism))


def announced_stream(spark: SparkSession, folder: str, tables_per_trigger: int = 10, max_file_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """The same of files that ``append_files(..., announce=n)`` has written: the stream is of the tables that announce
    them, and tasks read the files. So the driver lists and remembers a table for every ``n`` files."""
    names = spark.readStream.schema("name STRING").option("maxFilesPerTrigger", tables_per_trigger).parquet(f"{folder}/{ANNOUNCED}")
    return read_named(names, folder, max_file_bytes)


def estimate_stream(
    spark: SparkSession, folder: str, out: str, checkpoint: str, quality: int = 60, files_per_trigger: int = 1000,
    max_file_bytes: int = K.MAX_FILE_BYTES, announced: int | None = None,
) -> DataStreamWriter:
    """The batch plan on a file stream; oversized files get an error row like any other. With ``announced`` the stream
    is of announced files, and takes so many of their tables to a batch."""
    if announced is None:
        files = asset_stream(spark, folder, files_per_trigger, max_file_bytes)
    else:
        files = announced_stream(spark, folder, announced, max_file_bytes)
    rows = estimate_assets(files, quality, max_file_bytes=max_file_bytes)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
