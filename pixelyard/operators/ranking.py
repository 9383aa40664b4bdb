"""First-per-key, worst-per-format, orderings and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.functions.stats import floor_status
from pixelyard.plans.scale import lookup


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_per_case(
    iters: DataFrame, keys: Sequence[str] = ("case_id",), position="pos", ok: Column | None = None
) -> DataFrame:
    """First row by position of every key, among rows where ``ok`` holds; rows of one position go by
    their other columns in order, NULL first.

    An aggregate (the smallest struct), so each partition sends one row per key whatever the
    skew; a ranking window would send every row of a hot key to one task.
    """
    rows = iters if ok is None else iters.where(ok)
    rest = [c for c in iters.columns if c not in keys]
    best = rows.groupBy(*keys).agg(first_row(iters, rest, position).alias("__first"))
    return best.select(*[F.col(k) if k in keys else F.col(f"__first.{k}").alias(k) for k in iters.columns])


def first_row(df: DataFrame, columns: Sequence[str], position="pos") -> Column:
    """Aggregate: a struct of ``columns`` in the first row by position, then by those of the columns that have an
    order (maps have none). Rows without a position take no part."""
    ordered = [c for c in columns if not any(kind in df.schema[c].dataType.simpleString() for kind in ("map<", "variant"))]
    placed = _c(position).isNotNull()
    if len(ordered) == len(columns):
        return F.min(F.when(placed, F.struct(_c(position).alias("__at"), *columns)))
    return F.min_by(F.struct(*columns), F.when(placed, F.struct(_c(position).alias("__at"), *ordered)))


def ssim_floor(preset) -> Column:
    return lookup(K.SSIM_FLOOR, F.lower(_c(preset)), K.SSIM_FLOOR_DEFAULT)


def worst_per_format(iters: DataFrame, failed: Column | None = None, digits: int | None = 4) -> DataFrame:
    """One row per known format: the lossy case with the lowest SSIM (first on ties) and its status,
    a stub where there is no data, and a plain row for every lossless format.

    Expects case_id, format, preset, ssim, psnr_db, input_size, optimized_size, reduction_pct, pos.
    """
    spark = iters.sparkSession
    ok = None if failed is None else ~failed
    first = first_per_case(iters, ok=ok).where(F.col("format").isin(*K.LOSSY_FORMATS) & F.col("ssim").isNotNull())
    columns = ["case_id", "preset", "ssim", "psnr_db", "input_size", "optimized_size", "reduction_pct"]
    worst = first.groupBy("format").agg(
        F.min_by(F.struct(*columns), F.struct("ssim", "pos")).alias("w")
    )
    known = [(f, False) for f in K.LOSSY_FORMATS] + [(f, True) for f in K.LOSSLESS_FORMATS]
    formats = spark.createDataFrame(known, "format string, lossless boolean")
    joined = formats.join(worst, "format", "left")
    floor = F.when(F.col("w").isNotNull(), ssim_floor("w.preset"))
    status = floor_status(F.col("w.ssim"), floor, K.WARN_SSIM_FACTOR)
    rnd = (lambda c, d: c) if digits is None else F.bround
    return joined.select(
        "format",
        F.col("w.case_id").alias("case_id"),
        F.col("w.preset").alias("preset"),
        rnd(F.col("w.ssim"), 4).alias("ssim"),
        rnd(F.col("w.psnr_db"), 2).alias("psnr_db"),
        floor.alias("ssim_threshold"),
        F.when(status == 2, "fail").when(status == 1, "warn").otherwise("ok").alias("status"),
        rnd(F.coalesce(F.col("w.input_size") / 1024, F.lit(0.0)), 1).alias("size_orig_kb"),
        rnd(F.coalesce(F.col("w.optimized_size") / 1024, F.lit(0.0)), 1).alias("size_opt_kb"),
        rnd(F.coalesce(F.col("w.reduction_pct"), F.lit(0.0)), 1).alias("reduction_pct"),
        "lossless",
        (~F.col("lossless") & F.col("w").isNull()).alias("no_data"),
    )


def severity(status) -> Column:
    return F.coalesce(lookup({"fail": 0, "warn": 1, "ok": 2}, _c(status)), F.lit(3))


def severity_order(df: DataFrame, status="overall_status", fmt="format") -> DataFrame:
    """Fail, warn, ok; then by format."""
    return df.orderBy(severity(status), _c(fmt))


def by_status_then_worst(df: DataFrame, status: str, worst: str) -> DataFrame:
    """Roll-up order: regressions, noise, neutral, improvements; worst change first within each."""
    rank = lookup({"regression": 0, "noise": 1, "neutral": 2, "improvement": 3}, F.col(status), 99)
    return df.orderBy(rank, F.col(worst).desc())


def by_magnitude(df: DataFrame, delta: str, *ties: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(delta)).desc(), *ties)


def last_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The newest ``n`` rows, oldest first. The limit is the feature; it runs as a top-n."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)


def top_k(df: DataFrame, k: int, measure: Column, *ties: str) -> DataFrame:
    return df.orderBy(measure.desc(), *ties).limit(k)
