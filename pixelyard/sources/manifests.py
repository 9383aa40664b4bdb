"""Corpus manifests: one row per entry, with rejects for what does not follow the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelyard import constants as K

ENTRY = """name STRING, bucket STRING, content_kind STRING, seed BIGINT, width BIGINT, height BIGINT,
 output_formats ARRAY<STRING>, params MAP<STRING,STRING>, tags ARRAY<STRING>, expected_pixel_sha256 STRING,
 encoded_sha256 MAP<STRING,MAP<STRING,STRING>>,
 source STRUCT<url: STRING, sha256: STRING, license: STRING, attribution: STRING, notes: STRING>,
 expected_byte_sha256 MAP<STRING,STRING>, bit_depth INT"""
MANIFEST = f"""manifest_version INT, manifest_name STRING, library_versions MAP<STRING,STRING>,
 entries ARRAY<STRUCT<{ENTRY}>>, _corrupt STRING"""
_REQUIRED = ("name", "bucket", "content_kind", "seed", "width", "height", "output_formats")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(MANIFEST).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file"))


def _header_problem() -> Column:
    return (
        F.when(F.col("_corrupt").isNotNull(), "parse_error")
        .when(~F.coalesce(F.col("manifest_version").isin(1, 2), F.lit(False)), "unsupported_version")
        .when(F.col("manifest_name").isNull() | F.col("entries").isNull(), "invalid_header")
    )


def _entry_problem() -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for field in _REQUIRED:
        out = out.when(F.col(field).isNull(), f"missing {field}")
    out = out.when(~F.col("bucket").isin(*[b for b, _, _ in K.BUCKETS]), "unknown bucket")
    source = F.col("source")
    gap = source.isNotNull() & (
        source["url"].isNull() | source["sha256"].isNull() | source["license"].isNull() | source["attribution"].isNull()
    )
    return out.when(gap, "invalid source")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    good = _documents(spark, path).where(_header_problem().isNull())
    rows = good.select("file", "manifest_name", "manifest_version", F.inline("entries"))
    empty_map = F.create_map().cast("map<string,string>")
    return rows.withColumns(
        {
            "params": F.coalesce("params", empty_map),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "problem": _entry_problem(),
        }
    )


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _entries(spark, path).where(F.col("problem").isNull()).drop("problem")


def rejected_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, problem) of refused documents and entries."""
    documents = _documents(spark, path).select("file", F.lit(None).cast("string").alias("name"), _header_problem().alias("problem"))
    entries = _entries(spark, path).select("file", "name", "problem")
    return documents.unionByName(entries).where(F.col("problem").isNotNull())
