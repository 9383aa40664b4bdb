"""Pixel-quality metrics of image pairs and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.functions.pixels import mean_squared_error, psnr, ssim
from pixelyard.operators.cases import with_total
from pixelyard.operators.ranking import first_per_case, ssim_floor
from pixelyard.plans import quantiles

METRICS = ("ssim", "psnr_db", "ssimulacra2", "butteraugli_max", "butteraugli_3norm")


def psnr_pairs(pairs: DataFrame, reference="ref", distorted="dist", digits: int | None = 4) -> DataFrame:
    """Adds ``mse``, ``psnr_db`` and ``perfect_match``; all NULL when shapes differ."""
    out = pairs.withColumn("mse", mean_squared_error(reference, distorted))
    return out.withColumns({"psnr_db": psnr("mse", digits), "perfect_match": F.col("mse") == 0})


def psnr_pixels(pixels: DataFrame, keys: Sequence[str], reference="ref", distorted="dist", digits: int | None = 4) -> DataFrame:
    """The same from one row per pixel value; the mean is a map-side combined aggregate."""
    gap = F.col(reference).cast("double") - F.col(distorted).cast("double")
    out = pixels.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"))
    return out.withColumns({"psnr_db": psnr("mse", digits), "perfect_match": F.col("mse") == 0})


def ssim_pairs(pairs: DataFrame, reference="ref", distorted="dist", height="height", width="width", channels="channels") -> DataFrame:
    """Adds ``ssim`` of flattened row-major images; NULL where a pair's sizes differ from its shape."""
    return pairs.withColumn("ssim", ssim(reference, distorted, height, width, channels))


def metric_summary(rows: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(metric, format or total): n, median and p95 of every non-NULL score."""
    present = [m for m in metrics if m in rows.columns]
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in present])
    long = rows.select("format", F.inline(entries)).where(F.col("score").isNotNull())
    specs = [("median", "score", 50), ("p95", "score", 95)]
    return quantiles.aggregate(with_total(long, "format"), ["metric", "format"], specs, [F.count(F.lit(1)).alias("n")], few=True)


def quality_summary(iters: DataFrame, position: str = "pos") -> DataFrame:
    """Per format, one row per case: SSIM p50 and p05, PSNR p50, and how many cases are below the
    floor of their preset. ``iters`` must already exclude failed rows and rows without scores."""
    rows = first_per_case(iters.select("case_id", "format", "preset", "ssim", "psnr_db", position), position=position)
    specs = [("ssim_p50", "ssim", 50), ("ssim_p05", "ssim", 5), ("psnr_p50", "psnr_db", 50)]
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ssim") < ssim_floor("preset")).alias("below_threshold"),
    ]
    return quantiles.aggregate(rows, ["format"], specs, aggs, few=True)
