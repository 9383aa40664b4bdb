"""Manifests, case expansion, verification, digests and rebuild decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.functions.text import case_id
from pixelyard.operators.screening import in_bucket, size_bucket
from pixelyard.plans.scale import join_on, lookup


def expand_cases(
    entries: DataFrame, presets: Sequence[str] | None = None, bucket: str | None = None, tag: str | None = None,
    exclude_tag: str | None = None, formats: Sequence[str] | None = None, files: DataFrame | None = None,
    skip_missing: bool = True,
) -> DataFrame:
    """Entry x output format x preset. Presets are a literal array exploded in place, no join.

    ``files(name, format, size)`` limits the result to files that exist and adds ``input_size``;
    with ``skip_missing=False`` the missing ones stay, with a NULL size, for the caller to refuse.
    """
    known = {name: quality for name, quality, _ in K.PRESETS}
    wanted = list(presets) if presets else list(known)
    unknown = sorted(set(wanted) - set(known))
    if unknown:
        raise ValueError(f"unknown presets: {unknown}")
    rows = entries
    if bucket:
        rows = rows.where(F.col("bucket") == bucket)
    if tag:
        rows = rows.where(F.array_contains("tags", tag))
    if exclude_tag:
        rows = rows.where(~F.coalesce(F.array_contains("tags", exclude_tag), F.lit(False)))
    rows = rows.select("name", "bucket", F.explode("output_formats").alias("format"))
    if formats:
        rows = rows.where(F.col("format").isin(*formats))
    rows = rows.select("*", F.explode(F.array(*[F.lit(p) for p in wanted])).alias("preset"))
    out = rows.select(
        case_id(F.col("name"), F.col("format"), F.col("preset")).alias("case_id"),
        "name", "bucket", "format", "preset",
        lookup(known, F.col("preset")).alias("quality"),
    )
    if files is None:
        return out
    sizes = files.select("name", "format", F.col("size").alias("input_size"))
    return join_on(out, sizes, ["name", "format"], "inner" if skip_missing else "left")


def is_vector(formats="output_formats") -> Column:
    f = F.col(formats) if isinstance(formats, str) else formats
    return (F.size(f) > 0) & F.forall(f, lambda x: x.isin(*K.VECTOR_FORMATS))


def verify_manifest(entries: DataFrame, actual: DataFrame) -> DataFrame:
    """One verdict per entry: ok, mismatch, missing or schema_error.

    Vector entries compare the byte digest of their source, raster entries the pixel digest.
    ``actual(name, byte_sha256, pixel_sha256)``; an entry that could not be produced has no digest.
    """
    vector = is_vector()
    expected = F.when(vector, F.try_element_at("expected_byte_sha256", F.lit("source"))).otherwise(F.col("expected_pixel_sha256"))
    wanted = entries.select("name", vector.alias("is_vector"), expected.alias("expected"))
    found = join_on(wanted, actual.select("name", "byte_sha256", "pixel_sha256"), ["name"], "left")
    got = F.when(F.col("is_vector"), F.col("byte_sha256")).otherwise(F.col("pixel_sha256"))
    verdict = (
        F.when(F.col("expected").isNull(), "missing").when(got.isNull(), "schema_error").when(got != F.col("expected"), "mismatch").otherwise("ok")
    )
    return found.select("name", "is_vector", "expected", got.alias("actual"), verdict.alias("verdict"))


def manifest_exit(verdicts: DataFrame) -> DataFrame:
    """One row of counts and the exit code: schema errors 3, missing 2, mismatches 1, else 0."""
    n = {v: F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("ok", "mismatch", "missing", "schema_error")}
    row = verdicts.agg(*n.values())
    code = F.when(F.col("n_schema_error") > 0, 3).when(F.col("n_missing") > 0, 2).when(F.col("n_mismatch") > 0, 1).otherwise(0)
    return row.withColumn("exit_code", code)


def bucket_violations(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose size falls outside the bucket their entry declares."""
    declared = entries.select("name", "bucket")
    joined = join_on(files.select("name", "format", "size"), declared, ["name"])
    ok = F.coalesce(in_bucket("size", "bucket"), F.lit(False))
    return joined.where(~ok).withColumn("actual_bucket", size_bucket("size"))


def mixed_entries(entries: DataFrame) -> DataFrame:
    """Entries that list vector and raster formats together."""
    vector = lambda f: f.isin(*K.VECTOR_FORMATS)
    return entries.where(F.exists("output_formats", vector) & F.exists("output_formats", lambda f: ~vector(f)))


def content_digest(content) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def pixel_digest(image) -> Column:
    """Digest over channel mode, size and pixel bytes of an image struct, so equal pixels with a
    different shape differ."""
    i = F.col(image) if isinstance(image, str) else image
    head = F.concat(i["nChannels"].cast("string"), F.lit(":"), i["width"].cast("string"), F.lit("x"), i["height"].cast("string"), F.lit(":"))
    return F.sha2(F.concat(head.cast("binary"), i["data"]), 256)


def duplicates(assets: DataFrame, key: str, digest: Column, size: Column | None = None) -> DataFrame:
    """One row per digest that occurs more than once: copies, the smallest key, wasted bytes.

    Only digests travel, and each partition sends one partial row per digest, so a group that
    holds a third of all rows costs no more than any other.
    """
    amount = size if size is not None else F.lit(None).cast("bigint")
    rows = assets.select(digest.alias("digest"), F.col(key).alias("__key"), amount.alias("__size"))
    grouped = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_copies"), F.min("__key").alias("first_key"), F.max("__size").alias("__size")
    )
    return grouped.where(F.col("n_copies") > 1).select(
        "digest", "n_copies", "first_key", ((F.col("n_copies") - 1) * F.col("__size")).alias("wasted_bytes")
    )


def stale_files(wanted: DataFrame, present: DataFrame, keys: Sequence[str] = ("name", "format")) -> DataFrame:
    """build when absent, refetch when the digest differs, else skip. Both frames have ``sha256``."""
    have = present.select(*keys, F.col("sha256").alias("__have"), F.lit(True).alias("__there"))
    joined = join_on(wanted, have, list(keys), "left")
    action = (
        F.when(F.col("__there").isNull(), "build").when(~F.col("__have").eqNullSafe(F.col("sha256")), "refetch").otherwise("skip")
    )
    return joined.withColumn("action", action).drop("__have", "__there")
