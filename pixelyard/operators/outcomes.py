"""Optimization outcomes: candidate encodings of an asset and what is kept of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reduction_pct(original, optimized, digits: int | None = 1) -> Column:
    value = (F.lit(1.0) - F.try_divide(_c(optimized).cast("double"), _c(original).cast("double"))) * 100
    return value if digits is None else F.bround(value, digits)


def never_larger(
    df: DataFrame, original="original_size", optimized="optimized_size", method="method", digits: int | None = 1
) -> DataFrame:
    """A result that is not smaller is replaced by the original, 0 % and method none."""
    worse = _c(optimized) >= _c(original)
    return df.withColumns(
        {
            "optimized_size": F.when(worse, _c(original)).otherwise(_c(optimized)),
            "reduction_percent": F.when(worse, F.lit(0.0)).otherwise(reduction_pct(original, optimized, digits)),
            "method": F.when(worse, F.lit("none")).otherwise(_c(method)),
        }
    )


def best_candidate(
    candidates: DataFrame, keys: Sequence[str], original="original_size", size="size", method="method", position="ord",
    failed: Column | None = None,
) -> DataFrame:
    """Smallest candidate per asset, the first listed on ties; failures do not compete and an
    asset without a usable candidate keeps its original."""
    usable = _c(size).isNotNull() if failed is None else _c(size).isNotNull() & ~failed
    order = F.when(usable, F.struct(_c(size).alias("size"), _c(position).alias("ord")))
    best = candidates.groupBy(*keys).agg(
        F.first(_c(original), ignorenulls=True).alias("original_size"),
        F.min_by(F.struct(_c(size).alias("size"), _c(method).alias("method")), order).alias("__best"),
    )
    return best.select(
        *keys,
        "original_size",
        F.coalesce(F.col("__best.size"), F.col("original_size")).alias("optimized_size"),
        F.coalesce(F.col("__best.method"), F.lit("none")).alias("method"),
    )


def cap_reduction(
    ladder: DataFrame, keys: Sequence[str], target, original="original_size", size="size", quality="quality"
) -> DataFrame:
    """Lowest quality whose reduction stays within ``target`` percent, and the smallest size at it; NULL if
    none does."""
    target = F.lit(float(target)) if isinstance(target, (int, float)) else _c(target)
    within = reduction_pct(original, size, None) <= target
    at = F.when(within, _c(quality))
    order = F.when(at.isNotNull(), F.struct(at.alias("quality"), _c(size).alias("size")))
    return ladder.groupBy(*keys).agg(F.min(at).alias("quality"), F.min_by(_c(size), order).alias("size"))


def outcome_summary(
    outcomes: DataFrame, by: Sequence[str] = ("format", "preset"), reduction="reduction_percent", method="method"
) -> DataFrame:
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_c(reduction)).alias("avg_reduction"),
        F.min(_c(reduction)).alias("min_reduction"),
        F.max(_c(reduction)).alias("max_reduction"),
        F.array_sort(F.collect_set(_c(method))).alias("methods"),
        F.avg((_c(method) == "none").cast("double")).alias("noop_share"),
    )
