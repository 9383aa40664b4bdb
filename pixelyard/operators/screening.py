"""Admission, screening and configuration of assets (one row per asset)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.functions import text as X
from pixelyard.plans.scale import join_on, lookup, pinned


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- admission ----------------------------------------------------------------------


def decompressed_size(width, height, mode, frames=1) -> Column:
    """Bytes of all decoded frames; an unknown mode counts four bytes per pixel."""
    frames = F.lit(frames) if isinstance(frames, int) else _c(frames)
    per_pixel = lookup(K.MODE_BYTES, _c(mode), 4)
    return _c(width).cast("bigint") * _c(height).cast("bigint") * per_pixel * F.coalesce(frames, F.lit(1))


def image_too_large(
    width, height, mode, frames=1,
    max_pixels: int = K.MAX_PIXELS, max_bytes: int = K.MAX_DECOMPRESSED_BYTES, max_frames: int = K.MAX_FRAMES,
) -> Column:
    n = F.lit(frames) if isinstance(frames, int) else _c(frames)
    pixels = _c(width).cast("bigint") * _c(height).cast("bigint")
    over = (
        (F.coalesce(n, F.lit(1)) > max_frames)
        | (decompressed_size(width, height, mode, frames) > max_bytes)
        | (pixels > max_pixels)
    )
    return F.coalesce(over, F.lit(False))  # unknown dimensions pass: not a raster image


def admission(
    assets: DataFrame, size="length", fmt="format", width="width", height="height", mode="mode", frames="frames",
    max_file_bytes: int = K.MAX_FILE_BYTES,
) -> DataFrame:
    """Adds ``error_code`` and ``status``; the first failing rule decides, NULL means admitted."""
    code = (
        F.when(_c(size) > max_file_bytes, "file_too_large")
        .when(_c(fmt).isNull(), "unsupported_format")
        .when(image_too_large(width, height, mode, frames), "image_too_large")
    )
    out = assets.withColumn("error_code", code)
    return out.withColumn("status", F.coalesce(lookup(K.ERROR_STATUS, F.col("error_code")), F.lit(200)))


def memory_demand(fmt, size) -> Column:
    return _c(size).cast("bigint") * lookup(K.MEMORY_MULTIPLIERS, _c(fmt), 4)


def memory_by_format(assets: DataFrame, fmt="format", size="length") -> DataFrame:
    return assets.groupBy(_c(fmt).alias("format")).agg(
        F.count(F.lit(1)).alias("n_assets"), F.sum(memory_demand(fmt, size)).alias("memory_bytes")
    )


# --- URLs -----------------------------------------------------------------------------


def screen_urls(df: DataFrame, url: str = "url", resolved: DataFrame | None = None) -> DataFrame:
    """Adds ``host`` and ``reason``, the first rule that refuses the URL; NULL when it is safe.

    ``resolved(host, ip)`` stands for DNS: every address of a host must be allowed, and a host
    without a row is refused (address literals need none). It is reduced to one row per host
    before the join, so a host with many addresses or many URLs multiplies nothing; a host with
    very many URLs is split by the skew-join handling of adaptive execution.
    """
    # Parsed once per row, in columns of their own: every rule below reads them again.
    out = df.withColumns({"host": X.url_host(url), "__scheme": X.url_scheme(url)})
    out = out.withColumns({"__ip4": X.ipv4_number("host"), "__ip6": X.ipv6_digits("host")})
    host, address = F.col("host"), X.blocked_number("__ip4") | X.blocked_digits("__ip6")
    reason = (
        F.when((F.col("__scheme") != "https") | F.col("__scheme").isNull(), "scheme")
        .when(host == "", "no_host")
        .when(host.isin(*K.BLOCKED_HOSTS), "blocked_host")
        .when(F.contains(host, F.lit(":")) & F.col("__ip6").isNull(), "bad_address")  # brackets around no address
    )
    if resolved is not None:
        one = resolved.groupBy(F.lower("host").alias("host")).agg(F.bool_or(X.blocked_ip("ip")).alias("__blocked"))
        out = join_on(out, one, ["host"], "left")
        literal = F.col("__ip4").isNotNull() | F.col("__ip6").isNotNull()
        reason = reason.when(F.col("__blocked").isNull() & ~literal, "unresolved")
        address = address | F.coalesce(F.col("__blocked"), F.lit(False))
    reason = reason.when(address, "blocked_address")
    return out.select(*df.columns, "host", reason.alias("reason"))


def safe_urls(df: DataFrame, url: str = "url", resolved: DataFrame | None = None) -> DataFrame:
    return screen_urls(df, url, resolved).where(F.col("reason").isNull()).drop("host", "reason")


def redirect_screen(
    hops: DataFrame, chain: str, hop: str, url: str = "url", resolved: DataFrame | None = None,
    max_redirects: int = K.MAX_REDIRECTS,
) -> DataFrame:
    """One verdict per redirect chain; hop 0 is the first request."""
    screened = screen_urls(hops, url, resolved)
    verdict = screened.groupBy(chain).agg(
        F.count(F.lit(1)).alias("n_hops"),
        F.bool_and(F.col("reason").isNull()).alias("all_safe"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col(hop))).alias("first_reason"),
    )
    reason = F.when(~F.col("all_safe"), F.col("first_reason")).when(
        F.col("n_hops") - 1 > max_redirects, "too_many_redirects"
    )
    return verdict.select(
        chain, "n_hops", (F.col("n_hops") - 1).alias("n_redirects"), reason.alias("reason"),
        reason.isNull().alias("allowed"),
    )


# --- markup -----------------------------------------------------------------------------


def markup_threats(df: DataFrame, text: str) -> DataFrame:
    out = df.select("*", *X.markup_counts(text))
    total = sum((F.col(c) for c in out.columns[len(df.columns):]), F.lit(0))
    return out.withColumn("n_threats", total)


def sanitize_markup(df: DataFrame, text: str, xml: bool = False) -> DataFrame:
    """HTML is rewritten as text; with ``xml`` documents are parsed and bad ones get an error."""
    if not xml:
        tokens = pinned(df, __tokens=X.markup_tokens(text))
        return tokens.select(*df.columns, X.sanitize_tokens("__tokens").alias("clean"))
    cleaned = df.withColumn("__svg", X.sanitize_svg(F.col(text)))
    return cleaned.select("*", F.col("__svg.svg").alias("clean"), F.col("__svg.error").alias("error")).drop("__svg")


# --- configuration ------------------------------------------------------------------------


def resolve_preset(df: DataFrame, name: str = "preset") -> DataFrame:
    """Preset name to configuration; ``valid`` is false for an unknown name."""
    key = F.lower(F.col(name))
    quality = lookup({n: q for n, q, _ in K.PRESETS}, key)
    lossy = lookup({n: lossy for n, _, lossy in K.PRESETS}, key)
    known = quality.isNotNull()
    return df.select(
        "*",
        quality.alias("quality"),
        F.when(known, F.lit(True)).alias("strip_metadata"),
        F.when(known, F.lit(True)).alias("progressive_jpeg"),
        lossy.alias("png_lossy"),
        F.lit(None).cast("double").alias("max_reduction"),
        known.alias("valid"),
    )


def valid_config(df: DataFrame, quality="quality", max_reduction="max_reduction") -> DataFrame:
    """Fills the default quality and keeps rows whose values are in range."""
    q, cap = F.coalesce(_c(quality), F.lit(K.DEFAULT_QUALITY)), _c(max_reduction)
    ok = q.between(1, 100) & (cap.isNull() | cap.between(0, 100))
    return df.withColumn("quality", q).where(ok)


def clamp_quality(quality, offset: int = 10, lo: int = 30, hi: int = 90) -> Column:
    q = _c(quality) + offset
    return F.when(q < lo, lo).when(q > hi, hi).otherwise(q)  # NULL stays NULL


def regime(quality) -> Column:
    """0 below 50 (aggressive), 1 below 70 (moderate), 2 from 70 (gentle)."""
    q = _c(quality)
    return F.when(q < 50, 0).when(q < 70, 1).otherwise(2)


_RULE_FIELDS = (
    "format string, regime int, max_colors int, speed int, gif_lossy int, gif_colors int, webp_method int, "
    "svg_precision int, quality_cap int, reencodes boolean, candidates array<string>"
)


def _rules() -> list[tuple]:
    """One row per (format, quality regime); size gates are applied on top of them."""
    rows = []
    for r in (0, 1, 2):
        gentle = r == 2
        png = (64, 3) if r == 0 else (256, 4)
        rows.append(("png", r, *png, None, None, None, None, None, None, ["pngquant + oxipng", "oxipng"]))
        rows.append(("apng", r, None, None, None, None, None, None, None, None, ["oxipng"]))
        gif = [(80, 128), (30, 192), (None, None)][r]
        rows.append(("gif", r, None, None, *gif, None, None, None, None, ["gifsicle"]))
        rows.append(("webp", r, None, None, None, None, 4 if r == 0 else 3, None, None, None, ["pillow"]))
        rows.append(("jpeg", r, None, None, None, None, None, None, None, None, ["jpegli", "jpegtran"]))
        for vector in K.VECTOR_FORMATS:
            rows.append((vector, r, None, None, None, None, None, (3, 5, None)[r], None, None, ["scour"]))
        for fmt, cap in (("avif", 90), ("heic", 90), ("jxl", 95)):
            method = ["metadata-strip"] if gentle else [f"{fmt}-reencode"]
            rows.append((fmt, r, None, None, None, None, None, None, cap, not gentle, method))
        tiff = ["tiff_adobe_deflate", "tiff_lzw"] + ([] if gentle else ["tiff_jpeg"])
        rows.append(("tiff", r, None, None, None, None, None, None, None, None, tiff))
        bmp = ["pillow-bmp", "bmp-palette-lossless", "bmp-rle8-lossless"]
        bmp += ([] if gentle else ["pillow-bmp-palette"]) + (["bmp-rle8"] if r == 0 else [])
        rows.append(("bmp", r, None, None, None, None, None, None, None, None, bmp))
    return rows


def encoder_plan(
    assets: DataFrame, fmt="format", quality="quality", width="width", height="height", frames="frames",
    mode="mode", png_lossy="png_lossy", strip="strip_metadata",
) -> DataFrame:
    """What an encoder would be asked to do for each asset.

    A fixed table of 36 rules is broadcast and joined on (format, quality regime); rules that
    depend on size, mode or flags are expressions over the joined row.
    """
    spark = assets.sparkSession
    rules = F.broadcast(spark.createDataFrame(_rules(), _RULE_FIELDS).withColumnRenamed("format", "__fmt"))
    left = assets.withColumn("__regime", regime(quality))
    joined = left.join(rules, (_c(fmt) == F.col("__fmt")) & (F.col("__regime") == F.col("regime")), "left")
    f, q = _c(fmt), _c(quality)
    n = F.coalesce(_c(frames), F.lit(1)).cast("bigint")
    pixels = _c(width).cast("bigint") * _c(height).cast("bigint")
    pixel_frames = pixels * n

    png = f.isin("png", "apng")
    work = F.when(f == "apng", pixel_frames).otherwise(pixels)
    level = F.when(png, F.when((q < 70) & (work <= K.LARGE_PNG_PIXELS), 4).otherwise(2))
    quantizes = (f == "png") & _c(png_lossy)
    long_gif = (f == "gif") & (pixel_frames > K.LARGE_GIF_PIXEL_FRAMES)
    gif_method = (
        F.when(F.col("gif_lossy").isNull(), F.lit("gifsicle"))
        .when(long_gif, F.concat(F.lit("gifsicle --lossy="), F.col("gif_lossy"), F.lit(" (palette skipped: large animation)")))
        .otherwise(F.concat(F.lit("gifsicle --lossy="), F.col("gif_lossy"), F.lit(" --colors="), F.col("gif_colors")))
    )
    methods = (
        F.when((f == "png") & ~_c(png_lossy), F.array(F.lit("oxipng")))
        .when(f == "gif", F.array(gif_method))
        .when(f == "webp", F.array(F.concat(F.lit("pillow-m"), F.col("webp_method"))))
        .when((f == "tiff") & ~F.coalesce(_c(mode).isin("RGB", "L"), F.lit(False)),
              F.array_remove(F.col("candidates"), "tiff_jpeg"))
        .when(f.isin("avif", "heic", "jxl") & ~F.col("reencodes") & ~_c(strip), F.array().cast("array<string>"))
        .otherwise(F.col("candidates"))
    )
    return joined.select(
        *assets.columns,
        F.when(quantizes, F.col("max_colors")).alias("max_colors"),
        F.when(quantizes, F.col("speed")).alias("speed"),
        level.alias("oxipng_level"),
        F.col("gif_lossy"),
        F.when(~long_gif, F.col("gif_colors")).alias("gif_colors"),
        "webp_method",
        "svg_precision",
        F.when(F.col("reencodes"), F.greatest(F.lit(30), F.least(F.col("quality_cap"), q + 10))).alias("encoder_quality"),
        F.when(f == "tiff", pixels < K.TIFF_PARALLEL_PIXELS).alias("parallel_candidates"),
        methods.alias("candidates"),
    )


def skip_gate_avif(quality, width, height, size, strippable, strip=True) -> Column:
    """True when box headers already show that nothing can be gained."""
    q, w, h = _c(quality), F.coalesce(_c(width), F.lit(0)), F.coalesce(_c(height), F.lit(0))
    strips = F.lit(strip) if isinstance(strip, bool) else _c(strip)
    bpp = F.try_divide(_c(size) * F.lit(8.0), (w * h).cast("double"))
    return (
        F.when(q < 50, False)
        .when((w == 0) | (h == 0), False)
        .when(q < 70, bpp < 0.5)
        .otherwise(~strips | (_c(strippable) < 500))
    )


# --- size buckets ---------------------------------------------------------------------------


def size_bucket(size) -> Column:
    size = _c(size)
    out = F.when(size < 0, None)
    for name, _, high in K.BUCKETS:
        out = out.when(size < high, name) if high is not None else out.when(size.isNotNull(), name)
    return out


def in_bucket(size, bucket) -> Column:
    """NULL for an unknown bucket name."""
    size, bucket = _c(size), _c(bucket)
    low = lookup({n: lo for n, lo, _ in K.BUCKETS}, bucket)
    high = lookup({n: 2**62 if hi is None else hi for n, _, hi in K.BUCKETS}, bucket)
    return (size >= low) & (size < high)


def bucket_center(bucket) -> Column:
    centers = {n: 2 * lo if hi is None else math.isqrt(max(lo, 1) * hi) for n, lo, hi in K.BUCKETS}
    return lookup(centers, _c(bucket))
