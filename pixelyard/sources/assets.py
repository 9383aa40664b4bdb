"""Asset folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelyard import constants as K


def scan_assets(spark: SparkSession, path: str, max_bytes: int = K.MAX_FILE_BYTES, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of files up to ``max_bytes``. The size filter is
    pushed to the source: larger files are listed but never opened. Files without bytes are left out by the source."""
    return _together(_files(spark, path, recursive).where(F.col("length") <= max_bytes))


def rejected_assets(spark: SparkSession, path: str, max_bytes: int = K.MAX_FILE_BYTES, recursive: bool = True) -> DataFrame:
    """The files ``scan_assets`` leaves out; their content column is not read."""
    too_large = _files(spark, path, recursive).where(F.col("length") > max_bytes)
    return _together(too_large.select(
        "path", "length", F.lit("file_too_large").alias("error_code"), F.lit(K.ERROR_STATUS["file_too_large"]).alias("status")
    ))


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def _together(files: DataFrame) -> DataFrame:
    """Spark plans a partition for every 32 small files or 128 MB. Beyond eight to a core, up to 32 of these are
    read one after the other by one task, without a shuffle."""
    enough = files.sparkSession.sparkContext.defaultParallelism * 8
    return files.coalesce(max(enough, -(-files.rdd.getNumPartitions() // 32)))


def asset_heads(assets: DataFrame, n: int = 8192, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """First ``n`` bytes and the total size; 100 bytes are enough for PNG, 8192 for most JPEG."""
    return assets.select(*keep, F.col("length").alias("total_size"), F.substring("content", 1, n).alias("head"))


def decode_pixels(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """(origin, height, width, channels, image); pixel bytes are in BGR(A) order. Without
    ``drop_invalid`` an undecodable file stays with ``decoded`` false."""
    images = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)
    ok = F.col("image.height") > 0
    return images.select(
        F.col("image.origin").alias("path"),
        F.when(ok, F.col("image.height")).alias("height"),
        F.when(ok, F.col("image.width")).alias("width"),
        F.when(ok, F.col("image.nChannels")).alias("channels"),
        ok.alias("decoded"),
        "image",
    )
