"""Asset folder to savings table, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.functions.formats import detect_format, png_header, settle, uint_be
from pixelyard.functions.jpeg import raw_header
from pixelyard.operators import estimate as E
from pixelyard.operators.screening import admission
from pixelyard.plans.scale import pinned


def _uint_le(content: Column, offset: int, width: int) -> Column:
    total = F.lit(0).cast("bigint")
    for i in range(width):
        total = total + uint_be(content, offset + i, 1) * (256**i)
    return total


def identify(assets: DataFrame, content: str = "content", size: str = "length", deep: bool = True) -> DataFrame:
    """Adds format, headers, width, height, mode, bit depth and colour type; drops the content, so
    nothing downstream can shuffle it."""
    c = F.col(content)
    rest = [x for x in assets.columns if x != content]
    settled = settle(c) if deep else F.lit(None).cast("string")
    out = assets.withColumn("__settled", settled)
    out = pinned(out, format=detect_format(c, settled=F.col("__settled")))
    out = out.withColumn("__jpeg", raw_header(F.when(F.col("format") == "jpeg", c)))
    side = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    out = pinned(
        out,
        png=F.when(F.col("format").isin("png", "apng"), png_header(c)),
        jpeg=F.when(F.col("__jpeg.width").isNotNull(), F.col("__jpeg")),
        __other=F.when(F.col("format") == "gif", side(_uint_le(c, 6, 2), _uint_le(c, 8, 2))).when(
            F.col("format") == "bmp", side(_uint_le(c, 18, 4), _uint_le(c, 22, 4))
        ),
    )
    colour = F.col("png.color_type")
    mode = (
        F.when(colour == 0, "L").when(colour == 2, "RGB").when(colour == 3, "P").when(colour == 4, "LA").when(colour == 6, "RGBA")
        .when(F.col("jpeg.components") == 1, "L").when(F.col("jpeg").isNotNull(), "RGB")
    )
    return out.select(
        *rest, "format", "png", "jpeg",
        F.coalesce("png.width", "jpeg.width", "__other.width").alias("width"),
        F.coalesce("png.height", "jpeg.height", "__other.height").alias("height"),
        mode.alias("mode"),
        F.coalesce("png.bit_depth", "jpeg.bit_depth").alias("bit_depth"),
        F.when(F.col("png").isNotNull(), F.when(F.col("png.has_alpha"), "rgba").otherwise("rgb"))
        .when(F.col("jpeg").isNotNull(), F.when(F.col("jpeg.components") == 3, "rgb").otherwise("grayscale"))
        .alias("color_type"),
    )


def header_estimates(identified: DataFrame, quality: int, progressive: bool = True, size: str = "length") -> DataFrame:
    """Adds ``bpp`` or ``fallback_reason`` for PNG and JPEG rows in one pass over the same frame."""
    staged = identified.withColumns({"__q": F.lit(quality), "__p": F.lit(progressive)})
    names = identified.columns
    png = E.png_header_bpp(staged, "png", size, "__q").withColumnsRenamed({"bpp": "__png", "fallback_reason": "__png_reason"})
    both = E.jpeg_header_bpp(png, "jpeg", size, "__q", "__p")
    is_png, is_jpeg = F.col("format") == "png", F.col("format") == "jpeg"
    return both.select(
        *names,
        F.when(is_png, F.col("__png")).when(is_jpeg, F.col("bpp")).alias("bpp"),
        F.when(is_png, F.col("__png_reason")).when(is_jpeg, F.col("fallback_reason")).alias("fallback_reason"),
    )


def estimate_assets(
    assets: DataFrame, quality: int = 60, fitted: bool = True, samples: DataFrame | None = None, size: str = "length",
    key: str = "path", frames: DataFrame | None = None, deep: bool = True, max_file_bytes: int = K.MAX_FILE_BYTES,
) -> DataFrame:
    """Admission, identification, strategy, header model and result row for every asset.

    Assets the header models cannot serve take their outcome from ``samples`` (key, kind exact |
    sample, optimized_size, method, sample_pixels), measured elsewhere; without an outcome the row
    stays with NULL sizes and the strategy it needs. Refused assets keep their error code.
    """
    found = identify(assets, size=size, deep=deep)
    if frames is not None:
        found = found.join(frames.select(key, "frames"), key, "left")
    else:
        found = found.withColumn("frames", F.lit(1))
    found = admission(found, size=size, max_file_bytes=max_file_bytes)
    pixels = F.col("width").cast("bigint") * F.col("height").cast("bigint")
    scored = header_estimates(found, quality, size=size).withColumn("pixels", pixels)
    scored = scored.withColumns(
        {
            "__first": E.estimate_strategy("format", "pixels", size, "frames", fitted=fitted),
            "__plain": E.estimate_strategy("format", "pixels", size, "frames", fitted=False),
        }
    )
    scored = scored.withColumn("__tried", F.endswith("__first", F.lit("_header_only")))
    rows = scored.withColumn("__served", F.col("__tried") & F.col("bpp").isNotNull() & F.col("error_code").isNull())
    rows = rows.withColumn("path_taken", F.when(F.col("__served"), F.col("__first")).otherwise(F.col("__plain")))
    if samples is None:
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("optimized_size", "bigint"), ("sample_pixels", "bigint"), ("__method", "string"))})
    else:
        s = samples.select(key, "optimized_size", "sample_pixels", F.col("method").alias("__method"), F.col("kind").alias("__kind"))
        wants = F.when(F.col("path_taken") == "exact", "exact").otherwise("sample")
        rows = rows.withColumn("__kind", F.when(~F.col("__served"), wants)).join(s, [key, "__kind"], "left")
    sz = F.col(size).cast("bigint")
    measured = F.when(F.col("path_taken") == "exact", F.when(F.col("optimized_size").isNotNull(), F.least(F.col("optimized_size"), sz))).otherwise(
        E.size_from_bpp(E.bits_per_pixel("optimized_size", "sample_pixels"), F.col("pixels"), sz)
    )
    measured = F.when(F.col("__method") == "none", sz).otherwise(measured)
    estimated = F.when(F.col("__served"), E.size_from_bpp(F.col("bpp"), F.col("pixels"), sz)).otherwise(measured)
    rows = rows.withColumn("estimated_size", F.when(F.col("error_code").isNull(), estimated))
    rows = rows.withColumns(
        {
            "reduction": F.when(F.col("estimated_size").isNotNull(), E.reduction_from_size(sz, F.col("estimated_size"))),
            "method": F.when(F.col("__served"), F.col("path_taken")).otherwise(F.col("__method")),
            "confidence": F.when(F.col("__served"), "medium").otherwise("high"),
            "fallback_reason": F.when(F.col("__tried") & ~F.col("__served"), F.col("fallback_reason")),
        }
    )
    asset = F.col(key).alias("asset") if key == "path" else key  # ``path`` is the estimation path
    return E.build_estimate(rows, size=size, keep=(asset, "error_code"))
