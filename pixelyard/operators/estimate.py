"""Savings estimates: strategy, fitted bits per pixel, extrapolation and the result row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.functions.jpeg import source_quality
from pixelyard.functions.pixels import thumbnail_features
from pixelyard.functions.stats import potential
from pixelyard.operators.fitting import LinearModel

PNG_HEADER = LinearModel.from_artifact(K.PNG_HEADER_MODEL)
PNG_THUMBNAIL = LinearModel.from_artifact(K.PNG_THUMBNAIL_MODEL)
JPEG_HEADER = LinearModel.from_artifact(K.JPEG_HEADER_MODEL)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def at_least(value: Column, floor: float = 0.0) -> Column:
    """max(value, floor) that keeps NULL (``greatest`` alone would turn it into the floor)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def bits_per_pixel(size, pixels) -> Column:
    return F.try_divide(_c(size).cast("double") * 8.0, _c(pixels).cast("double"))


def estimate_strategy(
    fmt, pixels, size, frames=1, fitted: bool = False, jxl: bool = False, header_first: bool = True
) -> Column:
    """Which way an asset is estimated. ``fitted`` turns the header models on; with
    ``header_first`` a large PNG or JPEG tries its header before anything else."""
    f, px, n = _c(fmt), _c(pixels), F.lit(frames) if isinstance(frames, int) else _c(frames)
    compressed = ["jpeg", "webp", "heic", "avif"] + (["jxl"] if jxl else [])
    direct = [*compressed, "png", "apng", "tiff"]
    header = F.concat(f, F.lit("_header_only"))
    exact = (
        f.isin(*K.VECTOR_FORMATS)
        | (F.coalesce(n, F.lit(1)) > 1)
        | (px <= K.EXACT_PIXELS)
        | (f.isin("png", "apng") & (bits_per_pixel(size, px) < 2.0))
        | (f == "gif")
        | (f.isin(*compressed) & (_c(size) <= K.EXACT_FILE_BYTES))
    )
    out = F.when(f.isNull(), None)
    if fitted and header_first:
        out = out.when(f.isin("png", "jpeg") & (_c(size) >= K.HEADER_ONLY_MIN_BYTES), header)
    out = out.when(exact, "exact")
    if fitted:
        out = out.when(f.isin("png", "jpeg"), header)
    return out.when(f.isin(*direct), "direct_encode_sample").otherwise("generic_fallback_sample")


def plausible(bpp: Column, input_bpp: Column, quality: Column, ratio_reason: str = "prediction_oob") -> Column:
    """Reason a prediction is not believable, NULL when it is."""
    least = F.when(quality < 50, 0.05).when(quality < 70, 0.10).otherwise(0.40)
    ratio = F.try_divide(bpp, input_bpp)
    finite = bpp.isNotNull() & ~F.isnan(bpp) & (F.abs(bpp) < float("inf"))
    return F.when(~finite | (bpp < 0.001) | (bpp > 32.0), "prediction_oob").when(
        (input_bpp > 0) & ((ratio < least) | (ratio > 1.10)), ratio_reason
    )


def _verdict(df: DataFrame, refuse: Column, bpp: Column, input_bpp: Column, quality: Column, ratio_reason: str) -> DataFrame:
    # Each value gets a column before the checks read it again; inlined, the model formula would
    # be repeated once per check.
    staged = df.withColumns({"__bpp": bpp, "__input": input_bpp, "__refuse": refuse})
    reason = F.coalesce("__refuse", plausible(F.col("__bpp"), F.col("__input"), quality, ratio_reason))
    staged = staged.withColumn("__reason", reason)
    return staged.select(
        *df.columns, F.when(F.col("__reason").isNull(), F.col("__bpp")).alias("bpp"), F.col("__reason").alias("fallback_reason")
    )


def png_header_bpp(
    df: DataFrame, header="header", size="length", quality="quality", model: LinearModel | None = PNG_HEADER,
    max_pixels: int = K.MAX_PIXELS,
) -> DataFrame:
    """Adds ``bpp`` or ``fallback_reason`` (exactly one is set) from PNG header and file size."""
    h, q = _c(header), _c(quality)
    pixels = h["width"] * h["height"]
    input_bpp = bits_per_pixel(size, pixels)
    refuse = (
        F.when(h.isNull(), "header_parse_error")
        .when(pixels > max_pixels, "feature_oob")
        .when((input_bpp <= 0) | (input_bpp > K.PNG_MAX_INPUT_BPP), "feature_oob")
    )
    if model is None:
        return _verdict(df, F.coalesce(refuse, F.lit("model_load_failed")), F.lit(None).cast("double"), input_bpp, q, "")
    bpp = model.predict(
        {
            "has_alpha": h["has_alpha"].cast("double"),
            "quality": q,
            "log10_orig_pixels": F.log10(pixels.cast("double")),
            "input_bpp": input_bpp,
        }
    )
    return _verdict(df, refuse, bpp, input_bpp, q, "prediction_oob")


def dqt_stats(table) -> tuple[Column, Column]:
    """Mean and population deviation of a 64-entry table, 0 without one."""
    t = _c(table)
    n = F.size(t)
    mean = F.aggregate(t, F.lit(0.0), lambda s, x: s + x) / n
    squares = F.aggregate(t, F.lit(0.0), lambda s, x: s + x * x) / n
    var = squares - mean * mean  # exact: integers divided by 64
    usable = t.isNotNull() & (n == 64)
    return F.when(usable, mean).otherwise(0.0), F.when(usable, F.sqrt(var)).otherwise(0.0)


def jpeg_features(df: DataFrame, header="header", size="length", quality="quality", progressive="progressive_jpeg") -> DataFrame:
    """The thirteen header features as columns, plus ``pixels``; shared by fitting and scoring."""
    h = _c(header)
    matched = df.withColumn("__source", source_quality(h["dqt_luma"], h["dqt_chroma"]))
    pixels = h["width"] * h["height"]
    mean_l, std_l = dqt_stats(h["dqt_luma"])
    mean_c, std_c = dqt_stats(h["dqt_chroma"])
    return matched.select(
        *df.columns,
        pixels.alias("pixels"),
        _c(quality).cast("double").alias("target_quality"),
        F.col("__source.q").cast("double").alias("source_quality"),
        F.col("__source.nse").alias("nse"),
        *[
            (h["subsampling"] == f"4:{s[0]}:{s[1]}").cast("double").alias(f"subsampling_4{s}")
            for s in ("44", "22", "20")
        ],
        _c(progressive).cast("double").alias("progressive"),
        F.log10(pixels.cast("double")).alias("log10_orig_pixels"),
        bits_per_pixel(size, pixels).alias("input_bpp"),
        mean_l.alias("mean_dqt_luma"),
        std_l.alias("std_dqt_luma"),
        mean_c.alias("mean_dqt_chroma"),
        std_c.alias("std_dqt_chroma"),
    )


def jpeg_header_bpp(
    df: DataFrame, header="header", size="length", quality="quality", progressive="progressive_jpeg",
    model: LinearModel | None = JPEG_HEADER, max_pixels: int = K.MAX_PIXELS,
) -> DataFrame:
    """Adds ``bpp`` or ``fallback_reason`` from JPEG header and file size."""
    rich = jpeg_features(df, header, size, quality, progressive)
    h, q = _c(header), _c(quality)
    input_bpp = F.col("input_bpp")
    refuse = (
        F.when(h.isNull(), "header_parse_error")
        .when(h["fallback_reason"].isNotNull(), h["fallback_reason"])
        .when(F.col("pixels") > max_pixels, "feature_oob")
        .when((input_bpp <= 0) | (input_bpp > K.JPEG_MAX_INPUT_BPP), "feature_oob")
        .when(F.size(h["dqt_luma"]) != 64, "header_parse_error")
        .when(F.col("nse") < K.MIN_NSE, "custom_quantization")
    )
    if model is None:
        refuse = F.coalesce(refuse, F.lit("model_load_failed"))
    bpp = F.lit(None).cast("double") if model is None else model.predict()
    return _verdict(rich, refuse, bpp, input_bpp, q, "prediction_oob").select(*df.columns, "bpp", "fallback_reason")


def png_features(
    images: DataFrame, quality="quality", size="length", image="image", width=None, height=None, has_alpha=None,
    max_pixels: int = K.MAX_PIXELS,
) -> DataFrame:
    """Thumbnail features of decoded images. ``has_alpha`` overrides the channel count (a palette
    image with transparency decodes to plain channels). Features are NULL when out of bounds."""
    img = _c(image)
    w, h = _c(width) if width else img["width"], _c(height) if height else img["height"]
    pixels = w.cast("bigint") * h.cast("bigint")
    input_bpp = F.when(_c(size) > 0, bits_per_pixel(size, pixels)).otherwise(0.0)
    thumbs = images.withColumn(
        "__thumb", thumbnail_features(img["height"], img["width"], img["nChannels"], img["data"])
    )
    ok = (pixels <= max_pixels) & (input_bpp <= K.PNG_MAX_INPUT_BPP) & F.col("__thumb.mean_sobel").isNotNull()
    alpha = _c(has_alpha) if has_alpha is not None else img["nChannels"] == 4
    values = {
        "has_alpha": alpha.cast("double"),
        "log10_unique_colors": F.col("__thumb.log10_unique_colors"),
        "mean_sobel": F.col("__thumb.mean_sobel"),
        "edge_density": F.col("__thumb.edge_density"),
        "quality": _c(quality).cast("double"),
        "log10_orig_pixels": F.log10(F.greatest(pixels, F.lit(1)).cast("double")),
        "input_bpp": input_bpp,
    }
    keep = [c for c in images.columns if c not in values]
    return thumbs.select(*keep, pixels.alias("pixels"), *[F.when(ok, v).alias(n) for n, v in values.items()])


def png_fitted_bpp(features: DataFrame, model: LinearModel = PNG_THUMBNAIL) -> DataFrame:
    refuse = F.when(F.col("mean_sobel").isNull(), "mode_unsupported_or_oob")
    return _verdict(features, refuse, model.predict(), F.col("input_bpp"), F.col("quality"), "prediction_disagreement")


# --- extrapolation -------------------------------------------------------------------------


def sample_shape(fmt, width, height) -> tuple[Column, Column]:
    """Sample width and height: never upscaled, at least one row."""
    w, h = _c(width).cast("bigint"), _c(height).cast("bigint")
    sw = F.least(F.when(_c(fmt) == "jpeg", 1200).otherwise(800).cast("bigint"), w)
    ratio = F.try_divide(sw.cast("double"), w.cast("double"))
    return sw, F.greatest(F.lit(1).cast("bigint"), F.floor(h * ratio))


def reduction_from_size(size: Column, estimated: Column, digits: int | None = 1) -> Column:
    value = F.try_divide((size - estimated).cast("double"), size.cast("double")) * 100
    return at_least(value if digits is None else F.bround(value, digits))


def size_from_bpp(bpp: Column, pixels: Column, size: Column) -> Column:
    scaled = F.floor(bpp * pixels / 8.0).cast("bigint")
    return F.when(scaled.isNotNull(), F.least(scaled, size.cast("bigint")))


def extrapolate(
    df: DataFrame, fmt="format", width="width", height="height", size="length", sample_size="sample_size",
    method="sample_method", quality="quality", png_lossy="png_lossy", max_reduction="max_reduction",
    digits: int | None = 1,
) -> DataFrame:
    """Full-image size and reduction from a measured sample encoding."""
    f, sz, q, m = _c(fmt), _c(size).cast("bigint"), _c(quality), _c(method)
    pixels = _c(width).cast("bigint") * _c(height).cast("bigint")
    sw, sh = sample_shape(fmt, width, height)
    bpp = bits_per_pixel(sample_size, sw * sh)
    shrink = F.try_divide(_c(width).cast("double"), sw.cast("double"))
    lossless_tiff = (f == "tiff") & m.isin("tiff_adobe_deflate", "tiff_lzw") & (shrink > 1)
    bpp = F.when(lossless_tiff, bpp / (1.0 + 0.35 * F.log(shrink))).otherwise(bpp)

    staged = df.withColumn("__size", size_from_bpp(bpp, pixels, sz))
    staged = staged.withColumn("__red", reduction_from_size(sz, F.col("__size"), digits))

    def cap_at(limit: Column) -> Column:
        return F.floor(sz * (1.0 - limit / 100.0)).cast("bigint")

    cap = _c(max_reduction)
    cap_value = cap if digits is None else F.bround(cap, digits)
    capped = f.isin("jpeg", "webp") & cap.isNotNull() & (F.col("__red") > cap)
    staged = staged.withColumns(
        {
            "__size": F.when(capped, cap_at(cap_value)).otherwise(F.col("__size")),
            "__red": F.when(capped, cap_value).otherwise(F.col("__red")),
        }
    )
    photo = (
        f.isin("png", "apng")
        & ~(_c(png_lossy) & (q < 70))
        & (bits_per_pixel(sz, pixels) > 10.0)
        & (F.col("__red") > 5.0)
    )
    return staged.select(
        *df.columns,
        F.when(photo, cap_at(F.lit(5.0))).otherwise(F.col("__size")).alias("estimated_size"),
        F.when(photo, F.lit(5.0)).otherwise(F.col("__red")).alias("reduction"),
    )


def extrapolate_generic(
    df: DataFrame, pixels, size, sample_pixels, sample_size, method, digits: int | None = 1
) -> DataFrame:
    """Sample or thumbnail outcome scaled by pixel count; an untouched sample means no savings."""
    sz = _c(size).cast("bigint")
    untouched = _c(method) == "none"
    est = size_from_bpp(bits_per_pixel(sample_size, sample_pixels), _c(pixels), sz)
    return df.select(
        "*",
        F.when(untouched, sz).otherwise(est).alias("estimated_size"),
        F.when(untouched, F.lit(0.0)).otherwise(reduction_from_size(sz, est, digits)).alias("reduction"),
    )


def estimate_from_thumbnail(
    df: DataFrame, pixels="pixels", size="length", thumb_pixels="thumb_pixels", thumb_size="thumb_size",
    method="thumb_method", digits: int | None = 1,
) -> DataFrame:
    out = extrapolate_generic(df, pixels, size, thumb_pixels, thumb_size, method, digits)
    return out.withColumns({"confidence": F.lit("medium"), "path": F.lit("direct_encode_sample")})


# --- result row --------------------------------------------------------------------------------


def build_estimate(
    df: DataFrame, size="length", fmt="format", width="width", height="height", color="color_type", bits="bit_depth",
    estimated="estimated_size", reduction="reduction", method="method", confidence="confidence", path="path_taken",
    reason="fallback_reason", keep: Sequence[str | Column] = (),
) -> DataFrame:
    r = at_least(_c(reduction))
    return df.select(
        *keep,
        _c(size).alias("original_size"),
        _c(fmt).alias("original_format"),
        F.struct(_c(width).alias("width"), _c(height).alias("height")).alias("dimensions"),
        _c(color).alias("color_type"),
        _c(bits).alias("bit_depth"),
        _c(estimated).alias("estimated_optimized_size"),
        r.alias("estimated_reduction_percent"),
        F.when(r.isNotNull(), potential(r)).alias("optimization_potential"),
        _c(method).alias("method"),
        (r == 0).alias("already_optimized"),
        _c(confidence).alias("confidence"),
        _c(path).alias("path"),
        _c(reason).alias("fallback_reason"),
    )


def fallback_rollup(estimates: DataFrame, totals: bool = False) -> DataFrame:
    """Counts and mean reduction by (format, path, fallback reason); ``totals`` adds subtotals."""
    keys = ("original_format", "path", "fallback_reason")
    grouped = estimates.rollup(*keys) if totals else estimates.groupBy(*keys)
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), F.avg("estimated_reduction_percent").alias("mean_reduction")
    )


def savings_report(
    df: DataFrame, fmt="format", preset="preset", before="original_size", after="optimized_size", reduction="reduction_percent"
) -> DataFrame:
    """Bytes before and after per format and preset with all subtotals (NULL key = total)."""
    return (
        df.select(
            _c(fmt).alias("format"), _c(preset).alias("preset"), _c(before).alias("__b"), _c(after).alias("__a"),
            _c(reduction).alias("__r"),
        )
        .cube("format", "preset")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("__b").alias("bytes_before"),
            F.sum("__a").alias("bytes_after"),
            ((F.lit(1.0) - F.try_divide(F.sum("__a").cast("double"), F.sum("__b").cast("double"))) * 100).alias("weighted_reduction"),
            F.avg("__r").alias("avg_reduction"),
            F.min("__r").alias("min_reduction"),
            F.max("__r").alias("max_reduction"),
            F.grouping_id().alias("level"),
        )
    )


def features_for(model: LinearModel, columns: Mapping[str, Column]) -> list[Column]:
    return [columns[name].cast("double").alias(name) for name in model.features]
