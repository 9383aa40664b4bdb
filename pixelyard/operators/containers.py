"""Container segments and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard.functions.containers import make_strip_png_text, segments

_PNG_TEXT = ("tEXt", "iTXt", "zTXt")
_AVIF_META = ("Exif", "xml ", "xmp ", "mime")


def container_segments(assets: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, seq, depth, kind, offset, length, width, height, frames). Content is dropped here,
    so it is never shuffled."""
    return assets.select(key, F.posexplode(segments(F.col(content))).alias("seq", "s")).select(key, "seq", "s.*")


def animation_stats(segs: DataFrame, key: str = "path") -> DataFrame:
    """Frames and pixel-frames per asset. An APNG has its control chunk before the image data."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("seq")))
    shape = F.col("kind").isin("IHDR", "screen") & F.col("width").isNotNull()
    out = segs.groupBy(key).agg(
        first("acTL").alias("__control"),
        first("IDAT").alias("__data"),
        F.min_by("frames", F.when(F.col("kind") == "acTL", F.col("seq"))).alias("__apng_frames"),
        F.count_if(F.col("kind") == "image").alias("__gif_frames"),
        F.bool_or(F.col("kind") == "screen").alias("__is_gif"),
        F.min_by("width", F.when(shape, F.col("seq"))).alias("width"),
        F.min_by("height", F.when(shape, F.col("seq"))).alias("height"),
    )
    apng = F.col("__control").isNotNull() & (
        F.col("__data").isNull() | (F.col("__control") < F.col("__data"))
    )
    frames = F.when(F.col("__is_gif"), F.col("__gif_frames")).when(apng, F.col("__apng_frames")).otherwise(1)
    return out.select(
        key,
        apng.alias("is_apng"),
        frames.cast("bigint").alias("frames"),
        "width",
        "height",
        (F.col("width") * F.col("height") * frames).alias("pixel_frames"),
    )


def image_extent(segs: DataFrame, key: str = "path") -> DataFrame:
    """Dimensions of the first ``ispe`` property box."""
    at = F.when((F.col("kind") == "ispe") & (F.col("width") > 0), F.col("seq"))
    return segs.groupBy(key).agg(
        F.coalesce(F.min_by("width", at), F.lit(0)).alias("width"),
        F.coalesce(F.min_by("height", at), F.lit(0)).alias("height"),
    )


def strippable_bytes(segs: DataFrame, key: str = "path", keep_icc: bool = True) -> DataFrame:
    """Bytes that stripping metadata would remove, framing included."""
    text = _PNG_TEXT if keep_icc else (*_PNG_TEXT, "iCCP")
    return segs.groupBy(key).agg(
        F.sum(F.when(F.col("kind").isin(*text, *_AVIF_META), F.col("length")).otherwise(0)).alias("strippable")
    )


def strip_png_text(assets: DataFrame, content: str = "content", keep_icc: bool = True) -> DataFrame:
    return assets.withColumn(content, make_strip_png_text(keep_icc)(F.col(content)))


def png_signature(content: str | Column) -> Column:
    content = F.col(content) if isinstance(content, str) else content
    return F.substring(content, 1, 8) == F.lit(bytearray(b"\x89PNG\r\n\x1a\n"))
